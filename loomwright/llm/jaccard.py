"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

A text is the set of its distinct `words`-word shingles, as 64-bit hashes. Texts of equal sets form
a class, and only one of each partition's copies of a class goes on.

Two sets of Jaccard similarity t differ in at most (1 - t) / (1 + t) of their summed sizes, H
shingles. Sizes fall into bands; in the scheme of a band the universe is hashed into m segments,
and a set takes part in the schemes of its own band and of those that a larger partner may be in.

* Subsets: with m > H segments, sets that link agree in at least m - H whole segments. A set's
  part of a segment, if any, is one signature.
* One-deletion neighbourhoods: with m > H / 2 segments, sets that link differ by at most one
  shingle in some segment. A set's part of a segment is a full signature, the part less one
  shingle a deletion; two sets meet where at least one of them is full.

Shingles that many texts have, a passage in common, make common signatures. So both kinds come in
levels: at the first, shingles that LEVELS[0] of all texts have are left out (sets only get closer
by that), then only those of LEVELS[1], and at last none.

The allocation between the two kinds and the levels goes by cost. The cost of an option, for a
band, is the signatures that it makes, each at the price of a row and of comparisons with as many
sets as may share it: the counted frequency that the level lets in. Each band takes its options
from the cheapest on, and each set goes as far as the first that is enough: subsets, if more than H
parts aren't empty; neighbourhoods, if parts of one shingle and twice those of more are more than
H; with all shingles neighbourhoods take in empty parts too and always are, so a band's options end
there. Every linked pair shares a signature: both sets go as far as the nearer of their ends, where
one of them has enough. (Both sides must choose alike without seeing each other. So the choice is
by band and set, not by segment.)

Candidates: the members of one signature, in blocks of BLOCK, are compared by size and by parity
bitmaps. A bitmap has a bit for each hash value, flipped by each shingle of it; bitmaps of sets that
differ by d shingles differ in d bits at most. Pairs that differ in more than H bits can't link. Of
the rest only a forest goes on, so no pair becomes a row, and groups with the same members are
compared once. Its trees hold every link between them: each link is a candidate.

Verification: the members of a tree are dealt into squads, a whole set goes once to each pair of
squads that it is in, and the sizes of all intersections of a pair come from a product of incidence
matrices: exact, for all pairs of a tree, candidates or not. Each class's links are counted there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import kernel, scratch
from loomwright.llm.components import components

WORDS = 5
SIMILARITY = Fraction(4, 5)
#: Ratio of a band's sizes.
RATIO = 1.5
#: Shares of texts that have a shingle, and their number at least, for it to be left out of a level's signatures.
LEVELS, LEAST = (0.002, 0.008, 0.032, 0.128), 64
#: The most frequent shingles that workers are told; others are left out nowhere, which costs comparisons but no link.
COMMON = 1_000_000
#: Price of a signature's row, in comparisons of two bitmaps.
ROW = 200
#: Members of a signature that are compared at once; words of bitmaps gathered at once.
BLOCK, GATHER = 1024, 1 << 19
#: Bits of a bitmap for each shingle, to the next power of two, and at most.
BITS, MOST_BITS = 2, 1 << 17
#: Members of a tree and their shingles, on average, in each of the two squads that one task compares; columns of one matrix product.
SQUAD, SQUAD_SHINGLES, COLUMNS = 512, 500_000, 4096
_STEPS = np.array([pow(kernel.BASE, k, 1 << 64) for k in range(64)], np.uint64)


def shingles(raw: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of each row. Fewer than `words` words are one shingle, none are the empty set."""
    w = kernel.Words(raw, bounds, kernel.NONSPACE)
    h, first = w.hash, w.first
    if len(h) >= words:
        rolled = sum((h[k : len(h) - words + 1 + k] * _STEPS[words - 1 - k] for k in range(words)), np.zeros(len(h) - words + 1, np.uint64))
        rolled = kernel.mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(kernel.mix(np.array([(h[a:b] * _STEPS[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles at each hash value; the number of bits is a power of two. The halves of a bitmap, xored, are the bitmap of half as many bits."""
    bits = min(max(64, 1 << int(BITS * len(s) - 1).bit_length()), MOST_BITS)
    at = (kernel.mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


class Schemes:
    """levels: from how many texts on a shingle is left out at each level; none is at the last, which this doesn't name."""

    def __init__(self, t: Fraction, levels: list[float], texts: int):
        self.t, self.gap = t, (1 - t) / (1 + t)
        self.shared = [*levels, texts]  # sets that may share a signature of each level
        self.orders: dict[int, list[tuple[int, bool]]] = {}

    def differ(self, a: int, b: int) -> int:
        """Shingles by which linked sets of these sizes differ at most."""
        return int(self.gap * (a + b))

    def bands(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(number, largest size, segments that are to be more than) of the schemes for a set of n shingles."""
        lo, number = 1, 0
        while lo * self.t <= n:
            hi = max(lo, int(np.ceil(lo * RATIO)) - 1)
            if hi >= n:
                yield number, hi, self.differ(n, min(hi, int(n / self.t)))
            lo, number = hi + 1, number + 1

    def parts(self, top: int, at: int, near: bool) -> int:
        """Segments of an option."""
        if not near:
            return top + 3 + top // 8
        return top // 2 + 1 if at == len(self.shared) - 1 else top * 2 // 3 + 3

    def order(self, number: int, hi: int) -> list[tuple[int, bool]]:
        """(level, neighbourhoods?) of a band's options, cheapest first, up to the one that is always enough."""
        if number not in self.orders:
            top, last = self.differ(hi, hi), (len(self.shared) - 1, True)
            rows = {(at, near): self.parts(top, at, near) + (hi if near else 0) for at in range(len(self.shared)) for near in (False, True)}
            cost = {k: n * (ROW + self.shared[k[0]]) for k, n in rows.items()}
            self.orders[number] = [k for k in sorted(cost, key=lambda k: (cost[k], k)) if k != last and cost[k] <= cost[last]] + [last]
        return self.orders[number]

    def signatures(self, s: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        """(signatures, full?) of a set; level: from which level on each shingle counts."""
        out: list[tuple[np.ndarray, bool]] = []
        whole = len(self.shared) - 1
        for number, hi, most in self.bands(len(s)):
            top = self.differ(hi, hi)
            for at, near in self.order(number, hi):
                own = s if at == whole else s[level <= at]
                scheme = (number * (whole + 1) + at) * 2 + near
                total, segment, value = self.segments(own, scheme, self.parts(top, at, near))
                size = np.bincount(segment, minlength=len(total))
                every = near and at == whole
                filled = np.arange(len(total)) if every else np.flatnonzero(size)
                out.append((self.sign(total[filled], scheme, filled), True))
                if near:
                    less = np.ones(len(segment), bool) if every else size[segment] > 1
                    out.append((self.sign(total[segment[less]] - value[less], scheme, segment[less]), False))
                if every or (size > 0).sum() + near * (size > 1).sum() > most:
                    break
        return out

    @staticmethod
    def segments(s: np.ndarray, scheme: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of each segment's values, each shingle's segment, each shingle's value)."""
        own = kernel.mix(s + np.uint64((scheme + 1) * 0x9E37_79B9))
        segment, value = (own % np.uint64(m)).astype(np.int64), kernel.mix(own)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, value)
        return total, segment, value

    @staticmethod
    def sign(total: np.ndarray, scheme: int, segment: np.ndarray) -> np.ndarray:
        return kernel.mix(total + kernel.mix((segment + (scheme << 32)).astype(np.uint64)))


def link_sets(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row per input row: id, text_hash, n_shingles, class_id, text_group, component_id, n_links.

    text_hash: xxhash64 of the text, to tell apart rows that share an id. class_id: the least id of
    the same set. n_links: all other classes whose sets are similar enough. text_group: a number
    for all texts that links between texts join. component_id: the least id reachable by links, the
    row's own included.
    Cases: a null or empty text, or one without words, is the empty set, linked with nothing, not
    even with another empty set, and of no group; a null id gets null class and component and no group, and its text counts for
    no one's links; repeated rows are one class; rows that share an id but not a text are one
    document, which has the links of all its texts and joins what they reach; an empty table gives
    no rows; further columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with a bitmap if the task hasn't seen the set yet, and the counts of shingles that may be common."""
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = texts = 0
        uniques, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        names = ["kind", "id", "n", "a", "b", "bits", "text_hash"]

        def fold() -> None:
            nonlocal uniques, counts, held, size
            u, at = np.unique(np.concatenate([uniques, *held]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(len(at) - len(counts), np.int64)])
            total = np.bincount(at, weight, len(u)).astype(np.int64)
            least = max(2, int(LEVELS[0] / 2 * texts))
            uniques, counts, held, size = u[total >= least], total[total >= least], [], 0

        for batch in batches:
            ids = batch.column(0)
            for i, j, raw, bounds in kernel.slices(batch.column(1)):
                n, a, b, bits = [], [], [], []
                for r, s in enumerate(shingles(raw, bounds, words), i):
                    key = set_key(s) if len(s) else (0, 0)
                    n.append(len(s))
                    a.append(key[0])
                    b.append(key[1])
                    bits.append(None)
                    if len(s) and ids[r].is_valid and key not in seen:
                        seen.add(key)
                        held.append(s)
                        bits[-1] = bitmap(s)
                        size += len(s)
                        texts += 1
                if size > 1_000_000:
                    fold()
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bits, pa.binary()), batch.column(2).slice(i, j - i)], names=names)
        if held:
            fold()
        kernel.relax()
        least = max(3, int(LEVELS[0] / 2 * texts))
        u, c = uniques[counts >= least], counts[counts >= least]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.nulls(len(u), pa.int64()), pa.array(c), pa.array(u.view(np.int64)), pa.array(np.zeros(len(u), np.int64)), pa.nulls(len(u), pa.binary()), pa.nulls(len(u), pa.int64())], names=names)

    scanned = scratch.keep(hashed.mapInArrow(sets, "kind int, id long, n long, a long, b long, bits binary, text_hash long"), "jaccard-sets")
    every = scanned.filter("kind = 0").select("id", "text_hash", "n", "a", "b")
    classes = scanned.filter("kind = 0 and n > 0 and id is not null").groupBy("a", "b").agg(F.min("id").alias("class_id"), F.max("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("class"), "*"), "jaccard-classes")
    texts = max(classes.count(), 1)
    hot = scanned.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(LEAST, LEVELS[0] / 2 * texts))
    found = hot.orderBy(F.desc("n"), "a").limit(COMMON).collect()
    common = np.array([r.a for r in found], np.int64).view(np.uint64)
    order = np.argsort(common)
    from_level = 1 + np.searchsorted(np.array(LEVELS[1:]) * texts, np.array([r.n for r in found], float)[order], "right") if found else np.empty(0, np.int64)
    shared = spark.sparkContext.broadcast((common[order], from_level))
    schemes = Schemes(similarity, [max(LEAST, x * texts) for x in LEVELS], texts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        common, from_level = shared.value
        sigs: list[np.ndarray] = []
        full: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sigs, full, owners, size
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(full)), pa.array(np.concatenate(owners))], names=["sig", "whole", "a"])
            sigs, full, owners, size = [], [], [], 0
            return out

        for batch in batches:
            ids = batch.column(0)
            for i, _, raw, bounds in kernel.slices(batch.column(1)):
                for r, s in enumerate(shingles(raw, bounds, words), i):
                    if not len(s) or not ids[r].is_valid or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    level = np.zeros(len(s), np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        level = np.where(common[at] == s, from_level[at], 0)
                    for x, whole in schemes.signatures(s, level):
                        sigs.append(x)
                        full.append(np.full(len(x), whole))
                        owners.append(np.full(len(x), key[0], np.int64))
                        size += len(x)
                    if size > 200_000:
                        yield flush()
        if size:
            yield flush()
        kernel.relax()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    signed = docs.mapInArrow(sign, "sig long, whole boolean, a long").repartition(parts, "sig").sortWithinPartitions("sig", "a", F.col("whole").desc())
    blocks = scratch.keep(signed.mapInArrow(groups, "sig long, block int, hot boolean, members array<long>, wholes array<boolean>"), "jaccard-blocks")
    scratch.release(spark)
    close = scratch.keep(candidates(blocks, classes, parts, similarity), "jaccard-close")
    scratch.release(spark)
    tree = components(close)
    exact = scratch.keep(verify(docs, classes, tree, parts, words, similarity), "jaccard-exact")
    degree = exact.filter("kind = 0").groupBy(F.col("x").alias("class")).agg(F.sum("y").alias("n_links"))
    links = exact.filter("kind = 1").select("x", "y")

    label = scratch.keep(components(links), "jaccard-components")
    named = classes.select("class", "class_id", "a", "b").join(label.select(F.col("id").alias("class"), F.col("component").alias("text_group")), "class", "left").join(degree, "class", "left")
    named = named.withColumn("text_group", F.coalesce("text_group", "class"))
    least = named.groupBy("text_group").agg(F.min("class_id").alias("component"))
    named = scratch.keep(named.join(least, "text_group"), "jaccard-named")
    out = every.filter("n > 0").join(named.select("a", "b", "class_id", "text_group", "component", "n_links"), ["a", "b"], "left").unionByName(every.filter("n = 0"), allowMissingColumns=True)
    # a document of several texts joins the groups of all of them
    several = every.filter("id is not null").groupBy("id").agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi")).filter("lo != hi").select("id")
    several = scratch.keep(several, "jaccard-several")
    if not several.isEmpty():
        joint = out.join(several, "id").filter("component is not null").select(F.col("id").alias("x"), F.col("component").alias("y"))
        joined = scratch.keep(components(named.select(F.col("class_id").alias("x"), F.col("component").alias("y")).unionByName(joint)), "jaccard-joined")
        of_class, of_row = joined.select(F.col("id").alias("class_id"), F.col("component").alias("c")), joined.select("id", F.col("component").alias("d"))
        out = out.join(of_class, "class_id", "left").join(of_row, "id", "left").withColumn("component", F.coalesce("c", "d", "component"))
    known = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("class_id", "id")).alias("class_id"),
        F.when(known, F.col("text_group")).alias("text_group"),
        F.when(known, F.coalesce("component", "class_id", "id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, whole, a) sorted by sig, a and full ones first: the distinct members of each signature that has several, one of them full, in blocks of BLOCK. hot: one of several blocks, told from the first on."""
    sig, whole, a = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    hot_sig, block = None, 0  # the signature whose blocks have begun, its next block

    def emit(sig: np.ndarray, whole: np.ndarray, a: np.ndarray, first: np.ndarray, end: np.ndarray, blocks: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        n = end - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        bounds = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x[at])) for x in (a, whole)]
        return pa.RecordBatch.from_arrays([pa.array(sig[first]), pa.array(blocks.astype(np.int32)), pa.array(hot), *lists], names=["sig", "block", "hot", "members", "wholes"])

    def closed(end: bool) -> Iterator[pa.RecordBatch]:
        """What of the buffer is sure: all groups but the last one, and that one's whole blocks; all at the end."""
        nonlocal sig, whole, a, hot_sig, block
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (a[1:] != a[:-1])
        sig, whole, a = sig[keep], whole[keep], a[keep]
        if not len(sig):
            return
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        ends = np.append(first[1:], len(sig))
        if not end:
            rest, ends, first = first[-1], ends[:-1], first[:-1]
        if len(first) and sig[first[0]] == hot_sig:  # the end of a hot group
            yield emit(sig, whole, a, first[:1], ends[:1], np.array([block]), np.array([True]))
            first, ends = first[1:], ends[1:]
        full = np.concatenate([[0], np.cumsum(whole)])
        good = (ends - first > 1) & (full[ends] > full[first])
        for k in np.flatnonzero(good & (ends - first > BLOCK)):
            cuts = np.arange(first[k], ends[k], BLOCK)
            yield emit(sig, whole, a, cuts, np.minimum(cuts + BLOCK, ends[k]), np.arange(len(cuts)), np.ones(len(cuts), bool))
        good &= ends - first <= BLOCK
        if good.any():
            first, ends = first[good], ends[good]
            yield emit(sig, whole, a, first, ends, np.zeros(len(first)), np.zeros(len(first), bool))
        if end:
            return
        sig, whole, a = sig[rest:], whole[rest:], a[rest:]
        while len(sig) > BLOCK:
            if sig[0] != hot_sig:
                hot_sig, block = sig[0], 0
            yield emit(sig, whole, a, np.array([0]), np.array([BLOCK]), np.array([block]), np.array([True]))
            block += 1
            sig, whole, a = sig[BLOCK:], whole[BLOCK:], a[BLOCK:]

    for batch in batches:
        sig = np.concatenate([sig, batch.column(0).to_numpy(zero_copy_only=False)])
        whole = np.concatenate([whole, batch.column(1).to_numpy(zero_copy_only=False)])
        a = np.concatenate([a, batch.column(2).to_numpy(zero_copy_only=False)])
        yield from closed(False)
    yield from closed(True)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for the nodes that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            break
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def candidates(blocks: DataFrame, classes: DataFrame, parts: int, similarity: Fraction) -> DataFrame:
    """(x, y): forests over the members of each signature whose sizes and bitmaps allow a link. Classes go by a; should two have the same, they count as one here."""
    single = blocks.filter("not hot").groupBy("members", "wholes").agg(F.min("sig").alias("sig"))
    many = blocks.filter("hot").select("sig", "block", "members", "wholes")
    dealt = many.join(many.groupBy("sig").agg(F.max("block").alias("top")), "sig").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("top"))))
    dealt = dealt.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "members", "wholes")
    tasks = dealt.unionByName(single.select("sig", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("second"), "members", "wholes"))
    member = tasks.select("sig", "i", "j", "second", F.explode(F.arrays_zip("members", "wholes")).alias("m")).select("sig", "i", "j", "second", F.col("m.members").alias("a"), F.col("m.wholes").alias("whole"))
    member = member.join(classes.select("a", "n", "bits"), "a").select("sig", "i", "j", "second", "a", "whole", "n", "bits")
    met = member.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "second")
    num, den = similarity.numerator, similarity.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

        def fold() -> None:
            nonlocal xs, ys, size
            x, y = forest(np.concatenate(xs), np.concatenate(ys))
            xs, ys, size = [x], [y], 0

        for rows in whole_tasks(batches, 3):
            for x, y in allowed(rows, num, den):
                xs.append(x)
                ys.append(y)
                size += len(x)
                if size > 500_000:
                    fold()
            if len(xs[0]) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(xs[0]), pa.array(ys[0])], names=["x", "y"])
                xs[0], ys[0] = np.empty(0, np.int64), np.empty(0, np.int64)
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(xs[0]), pa.array(ys[0])], names=["x", "y"])

    return met.mapInArrow(compare, "x long, y long").distinct()


def whole_tasks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches that end where the first `keys` columns, by which the rows are sorted, change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        same = np.all([c == c[-1] for c in columns], axis=0)
        if same.all() and (not held or all(held[-1].column(k)[-1].as_py() == columns[k][-1] for k in range(keys))):
            held.append(batch)
            continue
        last = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def allowed(rows: pa.RecordBatch, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members, by a, that one of them full, their sizes and their bitmaps allow to link. Of a task of two blocks only pairs across."""
    sig, i, j, second, a, whole, n = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(7))
    column = rows.column(7).cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    words = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.uint64)
    start = (bounds[:-1] - bounds[0]) // 8
    length = np.diff(bounds) // 8

    def half(r: np.ndarray, w: int) -> np.ndarray:
        """The bitmaps of rows r, each folded to w words."""
        at = start[r][:, None] + np.arange(w)
        out = words[at]
        for k in range(1, int(length[r].max()) // w):
            long = length[r] > k * w
            out[long] ^= words[at[long] + k * w]
        return out

    first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    ends = np.append(first[1:], len(sig))
    sizes = ends - first
    end = np.repeat(ends, sizes)
    others = np.repeat(ends - np.add.reduceat(second.astype(np.int64), first), sizes)  # first row of the second block
    row = np.arange(len(sig))
    begin = np.where(i == j, row + 1, np.where(second, end, others))
    count = end - begin
    total = np.concatenate([[0], np.cumsum(count)])
    p = 0
    while p < len(sig):
        q = max(p + 1, int(np.searchsorted(total, total[p] + GATHER, "right")) - 1)
        x = np.repeat(row[p:q], count[p:q])
        y = np.arange(len(x)) - np.repeat(total[p:q] - total[p], count[p:q]) + np.repeat(begin[p:q], count[p:q])
        p = q
        fits = (whole[x] | whole[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
        x, y = x[fits], y[fits]
        w = np.minimum(length[x], length[y])
        for wide in np.unique(w).tolist():
            at = np.flatnonzero(w == wide)
            for k in range(0, len(at), max(1, GATHER // wide)):
                u, v = x[at[k : k + max(1, GATHER // wide)]], y[at[k : k + max(1, GATHER // wide)]]
                flips = np.bitwise_count(half(u, wide) ^ half(v, wide)).sum(axis=1, dtype=np.int64)
                near = flips <= (den - num) * (n[u] + n[v]) // (den + num)
                yield a[u[near]], a[v[near]]


def verify(docs: DataFrame, classes: DataFrame, tree: DataFrame, parts: int, words: int, similarity: Fraction) -> DataFrame:
    """kind 0: (class, how many of one squad's other classes it links to); kind 1: (class, class), forests over all links.

    tree: (id, component), the a of the classes that may link. A squad's members go to its tasks
    with every squad of the component, its own included, as many times as the component has squads.
    """
    own = tree.select(F.col("id").alias("a"), "component").join(classes.drop("bits"), "a")
    size = own.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SQUAD), F.ceil(F.sum("n") / SQUAD_SHINGLES)).cast("int").alias("squads"))
    member = own.join(size, "component").select("component", "squads", F.pmod(F.xxhash64("class"), F.col("squads")).cast("int").alias("squad"), "class", F.col("class_id").alias("id"), "a", "b")
    member = scratch.keep(member, "jaccard-squads")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True))
            for i, _, raw, bounds in kernel.slices(batch.column(4)):
                out, kept = [], []
                for r, s in enumerate(shingles(raw, bounds, words), i):
                    if len(s) and set_key(s) == keys[r]:  # a text of the class, not another of its id
                        kept.append(r)
                        out.append(s.tobytes())
                chosen = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(chosen) for k in range(4)), pa.array(out, pa.binary())], names=["component", "squads", "squad", "class", "members"])

    # a merge join, as it has to be at any large size
    filled = docs.join(member.hint("merge"), "id").select("component", "squads", "squad", "class", "text", "a", "b")
    filled = filled.mapInArrow(fill, "component long, squads int, squad int, class long, members binary")
    dealt = filled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("squads") - 1)))
    dealt = dealt.select("component", F.least("squad", "other").alias("i"), F.greatest("squad", "other").alias("j"), "squad", "class", "members")
    met = dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "squad", "class")
    num, den = similarity.numerator, similarity.denominator

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, sets, second = None, [], [], 0  # second: members of the task's first squad
        done: list[np.ndarray] = []

        def close() -> None:
            if task is None or len(sets) < 2:
                return
            cut = len(sets) if task[1] == task[2] else second
            left, right = sets[:cut], sets if cut == len(sets) else sets[cut:]
            n = linked(left, right, num, den)
            if cut == len(sets):
                np.fill_diagonal(n, 0)
                links = n.sum(axis=1)
            else:
                links = np.concatenate([n.sum(axis=1), n.sum(axis=0)])
            some = links > 0
            done.append(np.stack([np.zeros(some.sum(), np.int64), np.array(names)[some], links[some]]))
            u, v = np.nonzero(n)
            own = np.array(names)
            x, y = forest(own[u], own[v + (0 if cut == len(sets) else cut)])
            done.append(np.stack([np.ones(len(x), np.int64), x, y]))

        def flush() -> pa.RecordBatch:
            nonlocal done
            out = np.concatenate([np.empty((3, 0), np.int64), *done], axis=1)
            done = []
            return pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int32)), pa.array(out[1]), pa.array(out[2])], names=["kind", "x", "y"])

        for batch in batches:
            a, b, c, d, e = (batch.column(k).to_pylist() for k in range(5))
            for key, squad, x, m in zip(zip(a, b, c, strict=True), d, e, batch.column(5), strict=True):
                if key != task:
                    close()
                    task, names, sets, second = key, [], [], 0
                if names and names[-1] == x:  # a repeated row
                    continue
                names.append(x)
                sets.append(np.frombuffer(m.as_py(), np.uint64))
                second += squad == key[1]
            if done:
                yield flush()
        close()
        yield flush()
        kernel.relax()

    return met.mapInArrow(count, "kind int, x long, y long")


def linked(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether each set of left and each of right are of Jaccard similarity num / den at least."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.int64)
    n = [np.array([len(s) for s in side]) for side in (left, right)]
    one = left is right or (len(left) == len(right) and all(x is y for x, y in zip(left, right, strict=True)))
    sets = left if one else [*left, *right]
    shingle, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # shingles of one set only are in no intersection but with itself
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - first] = 1
        both += (block @ block.T if one else block[: len(left)] @ block[len(left) :].T).astype(np.int64)
    return (both * den >= num * (n[0][:, None] + n[1][None, :] - both)).astype(np.int64)
