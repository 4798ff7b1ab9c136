"""Benchmark decontamination by a Wu-Manber multi-pattern search over words.

The patterns are the windows of `window` consecutive words of the benchmark items; an item of
fewer words is one pattern. For the patterns of one length m:

* A shift table over blocks of B words says how far the search may move when a block ends at the
  current word: m - B + 1 if no pattern has it, else its least distance to a pattern's end.
* At shift 0 the hash of the block, the suffix, selects a bucket of patterns.
* Those whose first word agrees are compared word by word, at last as bytes.

Many searches run in step, each over a stretch of one document, so that the skipping is
vectorised; every position of every text is covered by exactly one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm import arrow, kernel

WINDOW = 10
#: Benchmark bytes that one search holds at a time; a larger benchmark is searched for in blocks. The driver takes about 40 times as much to compile a block, each worker about 10 times to hold it.
BLOCK_BYTES = 4 << 20
#: Words that one of the searches in step covers.
STRETCH = 256


def tokens(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = kernel.Words(raw, np.array([0, len(raw)]), kernel.ALNUM, hashed=False)
    return [w.low[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]


def block_hash(h: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    out = h[ends]
    for k in range(1, size):
        out = out * np.uint64(kernel.BASE) + h[ends - k]
    return kernel.mix(out)


class Source:
    """The words of all items of a block, one after another; item k has words first[k]:first[k + 1]."""

    def __init__(self, texts: list[str]):
        low, start, end, hashed, first, at, word = [], [], [], [], [np.zeros(1, np.int64)], 0, 0
        for _, _, raw, bounds in kernel.slices(pa.array(texts, pa.string())):
            w = kernel.Words(raw, bounds, kernel.ALNUM)
            low.append(w.low)
            start.append(w.start + at)
            end.append(w.end + at)
            hashed.append(w.hash)
            first.append(w.first[1:] + word)
            at, word = at + len(raw), word + len(w)
        empty = [np.empty(0, np.int64)]
        self.low, self.hash = np.concatenate([np.empty(0, np.uint8), *low]), np.concatenate([np.empty(0, np.uint64), *hashed])
        self.start, self.end, self.first = np.concatenate(empty + start), np.concatenate(empty + end), np.concatenate(first)

    text = kernel.Words.text


class Patterns:
    """Tables for the windows of one length: pattern p is the window at word at[p] of the source, of item owner[p] and of more[p]."""

    def __init__(self, length: int, source: Source, at: np.ndarray, owner: np.ndarray):
        self.m, self.source = length, source
        self.block = 1 if length == 1 else 2 if length < 6 else 3
        flat, count = source.hash, length - self.block + 1
        _, first, which, times = np.unique(block_hash(flat, at + length - 1, length), return_index=True, return_inverse=True, return_counts=True)
        keep = np.zeros(len(at), bool)
        keep[first[times == 1]] = True
        same: dict[bytes, int] = {}
        more: dict[int, list[int]] = {}
        for p in np.flatnonzero(times[which] > 1).tolist():  # windows of several items are one pattern
            q = same.setdefault(source.text(int(at[p]), int(at[p]) + length), p)
            if p == q:
                keep[p] = True
            else:
                more.setdefault(q, []).append(int(owner[p]))
        kept = np.flatnonzero(keep)
        suffix = block_hash(flat, at[kept] + length - 1, self.block)
        order = np.argsort(suffix, kind="stable")
        self.suffix, kept = suffix[order], kept[order]
        self.at, self.owner = at[kept], owner[kept]
        place = {int(p): k for k, p in enumerate(kept)} if more else {}
        self.more = {place[p]: x for p, x in more.items()}
        self.bits = int(np.clip(np.ceil(np.log2(len(kept) * count * 16)), 12, 24))
        self.shift = np.full(1 << self.bits, count, np.uint8 if count < 256 else np.int32)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, self.slot(block_hash(flat, self.at + j, self.block)), length - 1 - j)

    def slot(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence within a row."""
        m, none = self.m, np.empty(0, np.int64)
        begin, end = w.first[:-1] + m - 1, w.first[1:]  # where windows end
        count = np.maximum(0, -(-(end - begin) // STRETCH))
        if not count.sum():
            return none, none
        row = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        pos = begin[row] + nth * STRETCH
        stop = np.minimum(pos + STRETCH, end[row])
        ends, hashes = [], []
        while len(pos):
            hashed = block_hash(w.hash, pos, self.block)
            step = self.shift[self.slot(hashed)].astype(np.int64)
            here = step == 0
            if here.any():
                ends.append(pos[here])
                hashes.append(hashed[here])
            pos = pos + np.maximum(step, 1)
            going = pos < stop
            pos, stop = pos[going], stop[going]
        if not ends:
            return none, none
        at, hashed = np.concatenate(ends) - m + 1, np.concatenate(hashes)
        lo, hi = np.searchsorted(self.suffix, hashed, "left"), np.searchsorted(self.suffix, hashed, "right")
        some = hi > lo
        at, lo, size = at[some], lo[some], (hi - lo)[some]
        which = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(at, size)
        for k in range(m):
            same = self.source.hash[self.at[which] + k] == w.hash[at + k]
            at, which = at[same], which[same]
        same = np.fromiter((w.text(a, a + m) == self.source.text(b, b + m) for a, b in zip(at.tolist(), self.at[which].tolist(), strict=True)), bool, len(at))
        return at[same], which[same]


class Block(NamedTuple):
    items: list[str]
    groups: list[Patterns]


def compile_patterns(rows: Iterable[tuple[str, str | None]], window: int = WINDOW) -> Block:
    """The tables of a block; about 10 bytes for each byte of the items' texts."""
    rows = list(rows)
    source = Source([t or "" for _, t in rows])
    n = np.diff(source.first)
    lengths, groups = np.minimum(n, window), []
    for m in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == m)
        count = n[own] - m + 1
        owner = np.repeat(own, count)
        groups.append(Patterns(m, source, np.repeat(source.first[own], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner))
    return Block([item for item, _ in rows], groups)


def search_rows(column: pa.Array, block: Block) -> list[tuple[int, np.ndarray, set[str]]]:
    """For each row: words, [first, after the last) word of each occurrence, items."""
    out = []
    for i, j, raw, bounds in kernel.slices(column):
        w = kernel.Words(raw, bounds, kernel.ALNUM)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        items: list[set[str]] = [set() for _ in range(j - i)]
        for g in block.groups:
            at, which = g.search(w)
            rows = np.searchsorted(w.first, at, "right") - 1
            for r, a, p in zip(rows.tolist(), (at - w.first[rows]).tolist(), which.tolist(), strict=True):
                spans[r].append((a, a + g.m))
                items[r].add(block.items[g.owner[p]])
                items[r].update(block.items[k] for k in g.more.get(p, ()))
        n = np.diff(w.first)
        out += [(int(n[r]), np.array(spans[r], np.int32).reshape(-1, 2), items[r]) for r in range(j - i)]
    return out


def covered(spans: np.ndarray) -> int:
    """Words in the union of spans."""
    if not len(spans):
        return 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.concatenate([[0], reach[:-1]])
    return int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], before)).sum())


def benchmark_blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterable[tuple[list[tuple[str, str]], bool]]:
    """The benchmark in blocks of about block_bytes, and whether it is the last; the driver holds one at a time. Rows without an id or a text have no patterns."""
    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [(r.item, r.text) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()], k == n - 1


def contamination(df: DataFrame, text_col: str, bench: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with three columns more: n_words, n_hit and items (sorted as strings).

    Cases: a null or empty text has no words; an item without words occurs nowhere; a repeated
    item id owns the windows of all its texts; empty tables give no hits; names that df has
    already get an underscore (see arrow.fresh); every row gets one row, copies too.
    """
    spark = df.sparkSession
    own = df.columns
    spans_at, items_at, n_at = (arrow.fresh(df, x) for x in ("_spans", "_items", "_n"))
    long, text, many = T.LongType(), T.BinaryType(), T.ArrayType(T.StringType())
    out, at = df, own.index(text_col)
    for block, last in benchmark_blocks(bench, item_col, item_text_col, block_bytes):
        tables = spark.sparkContext.broadcast(compile_patterns(block, window))  # about 10 times block_bytes
        prior = None if out is df else [out.columns.index(x) for x in (spans_at, items_at)]

        def search(batch: pa.RecordBatch, tables=tables, prior=prior, last=last) -> list[pa.Array]:
            found = search_rows(batch.column(at), tables.value)
            if prior:
                old = [batch.column(p).to_pylist() for p in prior]
                found = [(n, np.concatenate([np.frombuffer(s, np.int32).reshape(-1, 2), more]), items | set(was)) for (n, more, items), s, was in zip(found, *old, strict=True)]
            spans = pa.array([covered(f[1]) for f in found], pa.int64()) if last else pa.array([f[1].tobytes() for f in found], pa.binary())
            return [pa.array([f[0] for f in found], pa.int64()), pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())), spans]

        fields = [T.StructField(arrow.fresh(df, "n_words"), long), T.StructField(arrow.fresh(df, "items"), many), T.StructField(arrow.fresh(df, "n_hit"), long)]
        if not last:
            fields = [T.StructField(n_at, long), T.StructField(items_at, many), T.StructField(spans_at, text)]
        out = arrow.add_columns(out, search, fields, keep=own if keep is None or not last else keep)
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(df: DataFrame, text_col: str, bench: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW) -> DataFrame:
    """Rows of df in which no benchmark window occurs, with df's columns. Cases: as in `contamination`; a null or empty text stays."""
    n_hit = arrow.fresh(df, "n_hit")
    return contamination(df, text_col, bench, item_col, item_text_col, window).filter(F.col(n_hit) == 0).select(*[F.col(f"`{c}`") for c in df.columns])
