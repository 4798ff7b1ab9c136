"""Byte-level BPE encoding and decoding with a pair occurrence index.

The pre-tokens of a partition's slice are taken once each and laid out as one sequence of symbols,
linked forwards and backwards. An index maps the rank of each mergeable pair to all positions at
which the pair begins. Ranks are applied in ascending order: all occurrences of a pair merge at
once, and the positions of the pairs that this makes join the lists of their ranks. A merge's
symbol only takes part in merges that were learned later, so new pairs have higher ranks, and one
ascending pass over the active ranks is what merging each pre-token by lowest rank gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwright.llm import arrow, kernel

#: White space of the tokenizer's regular expression engine.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
#: Below this lead byte of UTF-8 all engines agree on which code points are letters and digits.
AGREED = 0xD5


def pattern(letter: str, digit: str) -> str:
    """The public pre-token pattern of this tokenizer family."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{SPACE}{letter}{digit}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


#: Letters and digits that Unicode 16.0 added to 15.1, as hexadecimal ranges.
ADDED = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}


def ranges(kind: str) -> str:
    """Letters ("L") or digits ("N") as of Unicode 16.0, which the tokenizer's engine has, as the inside of a character class: Python's own tables are of 15.1, the regex module's are newer."""
    out, start = [], None
    for part in ADDED[kind].split():
        a, _, b = part.partition("-")
        out.append(rf"\U{int(a, 16):08x}-\U{int(b or a, 16):08x}")
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def careful() -> regex.Pattern:
    return regex.compile(pattern(ranges("L"), ranges("N")))


#: Bytes of distinct pre-tokens and their ids, and what Python adds to each, that a worker remembers; beyond that it forgets them all and starts anew.
REMEMBERED, ENTRY = 32 << 20, 200
#: Text bytes whose new pre-tokens are merged together.
GATHER = 2 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*ids.values(), *self.special.values()]) + 1
        self.pieces = [b""] * top
        for t, i in [*ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.pieces[i] = t
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.top = top
        keys = np.array([ids[a] * top + ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.quick = regex.compile(pattern(r"\p{L}", r"\p{N}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.held = 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, or the number of merges where there is none."""
        want = a * self.top + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], len(self.keys))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, none = len(raw), len(self.keys)
        if not n:
            return [b""] * len(words)
        first = np.cumsum([0, *map(len, words)])
        # position n is a wall: no pair has its symbol
        symbol = np.append(self.of_byte[raw], -1)
        after = np.arange(1, n + 2)
        after[n] = n
        before = np.arange(-1, n)
        ends = first[1:] - 1
        after[ends[ends >= 0]] = n
        before[first[:-1][first[:-1] < n]] = n
        at = np.flatnonzero(after[:n] < n)
        rank = self.ranks(symbol[at], symbol[after[at]])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.diff(rank)) + 1
            lo = 0
            for hi, r in zip([*edges.tolist(), len(rank)], rank[np.append(0, edges)].tolist(), strict=True):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)
                lo = hi

        some = rank < none
        if some.any():
            enter(at[some], rank[some])
        left, right, made = self.keys // self.top, self.keys % self.top, self.made
        slot = np.empty(none, np.int64)
        slot[self.order] = np.arange(none)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = left[slot[r]], right[slot[r]]
            follow = after[at]
            good = (symbol[at] == a) & (symbol[follow] == b)
            if not good.all():
                at = at[good]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of one symbol, pairs from the left
                at = np.unique(at)
                free = np.ones(len(at), bool)
                touch = np.flatnonzero(after[at[:-1]] == at[1:])
                for i in touch.tolist():
                    if free[i]:
                        free[i + 1] = False
                at = at[free]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = made[r]
            symbol[gone] = -2
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            prior = before[at]
            has = prior < n
            starts = np.concatenate([prior[has], at[inner]])
            if len(starts):
                rank = self.ranks(symbol[starts], symbol[after[starts]])
                some = rank < none
                if some.any():
                    enter(starts[some], rank[some])
        live = symbol[:n] >= 0
        ids = symbol[:n][live].astype("<u4").tobytes()
        bounds = (np.concatenate([[0], np.cumsum(live)])[first] * 4).tolist()
        return [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def parts(self, text: str) -> list[str]:
        """Pre-tokens; a special token is a part of its own."""
        find = self.quick if text.isascii() or max(text.encode()) < AGREED else careful()
        if self.cut is None or not any(s in text for s in self.special):
            return find.findall(text)
        out: list[str] = []
        for i, piece in enumerate(self.cut.split(text)):
            out += [piece] if i % 2 else find.findall(piece)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        known = self.known
        if self.held > REMEMBERED:
            known.clear()
            self.held = 0
        if not known:
            known.update({s: np.array([i], "<u4").tobytes() for s, i in self.special.items()})
        parts = [self.parts(t) for t in texts]
        fresh = list({w for p in parts for w in p} - known.keys())
        made = self.merge([w.encode() for w in fresh])
        known.update(zip(fresh, made, strict=True))
        self.held += sum(map(len, fresh)) + sum(map(len, made)) + ENTRY * len(fresh)
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def batches(column: pa.Array) -> list[list[str]]:
    """Texts in runs of about GATHER bytes; null is empty."""
    _, bounds = kernel.buffers(column)
    texts, out, i = kernel.texts(column), [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + GATHER, side="right")) - 1)
        out.append(texts[i:j])
        i = j
    return out


def encode(df: DataFrame, text_col: str, path: str, ids_col: str = "ids") -> DataFrame:
    """df and its texts' ids, as an array of integers.

    path: the vocabulary file; all workers must find it there. Cases: a null or empty text has no
    ids; special tokens written in a text get their own ids; repeated rows each get their ids; an
    empty table stays empty; if df has ids_col already, the new name gets an underscore.
    """
    at, name = df.columns.index(text_col), arrow.fresh(df, ids_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        v = vocabulary(path)
        ids = [x for texts in batches(batch.column(at)) for x in v.encode(texts)]
        bounds = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))]

    return arrow.add_columns(df, run, [T.StructField(name, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, ids_col: str, path: str, text_col: str = "decoded") -> DataFrame:
    """df and the text of its ids; null ids give the empty text, bytes that aren't UTF-8 the replacement character."""
    at, name = df.columns.index(ids_col), arrow.fresh(df, text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        v = vocabulary(path)
        return [pa.array([v.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(at).to_pylist()], pa.string())]

    return arrow.add_columns(df, run, [T.StructField(name, T.StringType())])


def round_trip(df: DataFrame, text_col: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep`, the number of ids, and digests of the ids and of the text decoded from them."""
    at = df.columns.index(text_col)
    names = [arrow.fresh(df, x) for x in ("n_tokens", "ids_sha256", "decoded_sha256")]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        v = vocabulary(path)
        ids = [x for texts in batches(batch.column(at)) for x in v.encode(texts)]
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return arrow.add_columns(df, run, [T.StructField(names[0], T.LongType()), *(T.StructField(x, T.StringType()) for x in names[1:])], keep)
