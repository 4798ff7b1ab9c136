"""Sharding by a k-d tree over document metadata, all in DataFrame operations.

Law `bytes`: shards hold nearly equal bytes. The unit is a group of equal texts, which stays in
one shard. The tree splits the units recursively: a node that must yield k shards is cut at the
weighted quantile of its first k // 2 shards (the weighted median for even k), along the metadata
dimension in which the node is widest, until every leaf is one shard of the target bytes.

The quantile is found without gathering rows: each node's bytes are summed into BINS bins of the
dimension, then the bin that holds the quantile into BINS finer ones. The driver sees at most
shards * BINS sums a pass. Within equal metadata the order is that of a hash, so a cut can fall
anywhere.

The tree takes every unit but those that alone exceed a leaf, fewer than `shards`; these are placed
first, the heaviest into the emptiest shard, and leave their leaves that much less to fill. A group
of equal texts above 1 + SLACK of a whole shard can't stay together and is dealt in pieces by id
hash, each PIECE of a shard, which the tree takes as it does other units.

A cut falls between two units, so leaves differ by parts of a unit. At the end a few units move from
the fullest leaves to the emptiest ones; the driver chooses them among MOVABLE of each leaf and power
of two of bytes.
"""

from __future__ import annotations

import bisect
import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.llm import scratch

BINS = 4096
PIECE = 0.01
SLACK = 0.10
#: Units of a leaf and power of two that may move, and the share of a shard below which a difference stays.
MOVABLE, EVEN = 8, 0.001
#: Rows that one task numbers within a shard.
RUN = 20_000
SPAN = 1 << 16


def text_place(c: Column) -> Column:
    """A number that grows with the first six bytes of a string, nearly in their order."""
    return F.coalesce(F.conv(F.hex(F.rpad(F.substring(c, 1, 6), 6, " ").cast("binary")), 16, 10).cast("double"), F.lit(0.0))


class Tree:
    """Nodes in arrays: an inner node has a dimension, a cut and two children, a leaf is its own child."""

    def __init__(self, shards: int):
        self.span = [(0, shards)]  # shards lo .. hi - 1
        self.dim, self.cut, self.left, self.right, self.depth = [1], [0], [0], [0], 0

    def leaves(self) -> list[int]:
        return [i for i in range(len(self.span)) if self.left[i] == i]

    def split(self, i: int, dim: int, cut: int) -> None:
        lo, hi = self.span[i]
        self.dim[i], self.cut[i], self.left[i], self.right[i] = dim + 1, cut, len(self.span), len(self.span) + 1
        for part in ((lo, middle(lo, hi)), (middle(lo, hi), hi)):
            self.span.append(part)
            self.dim.append(1)
            self.cut.append(0)
            self.left.append(len(self.span) - 1)
            self.right.append(len(self.span) - 1)

    def place(self, dims: list[str]) -> Column:
        """The leaf that a unit lies in: `depth` steps down from the root."""
        at = lambda values, kind: f"element_at({literals(values, kind)}, n + 1)"
        left = f"element_at(array({', '.join(dims)}), {at(self.dim, 'int')}) < {at(self.cut, 'bigint')}"
        return F.expr(f"aggregate(array_repeat(0, {self.depth}), 0, (n, _) -> if({left}, {at(self.left, 'int')}, {at(self.right, 'int')}))")


def literals(values: list[int], kind: str) -> str:
    return f"cast(array({', '.join(map(str, values))}) as array<{kind}>)"


def middle(lo: int, hi: int) -> int:
    return lo + (hi - lo) // 2


def cuts(units: DataFrame, tree: Tree, dims: list[str], quota: list[float]) -> list[tuple[int, int, int]]:
    """(leaf, widest dimension, key at the weighted quantile) of each leaf of more than one shard."""
    open_ = [i for i in tree.leaves() if tree.span[i][1] - tree.span[i][0] > 1]
    at = units.select(tree.place(dims).alias("node"), "weight", *dims).filter(F.col("node").isin(open_))
    spread = {r.node: r for r in at.groupBy("node").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum("weight").alias("weight")).collect()}
    found, todo = [], {}
    for i in open_:
        r = spread.get(i)
        if r is None:
            found.append((i, 0, 0))
            continue
        widths = [r[f"hi_{d}"] // SPAN - r[f"lo_{d}"] // SPAN for d in dims]
        dim = widths.index(max(widths))
        lo, hi = tree.span[i]
        whole = sum(quota[lo:hi])
        todo[i] = (dim, r[f"lo_{dims[dim]}"], r[f"hi_{dims[dim]}"] + 1, r.weight * (sum(quota[lo : middle(lo, hi)]) / whole if whole > 0 else 0.5))
    while todo:
        # (dimension, first key, key after the last, bytes wanted from there) of each node
        nodes = max(todo) + 1
        step = {i: max(1, -(-(hi - lo) // BINS)) for i, (_, lo, hi, _) in todo.items()}
        put = lambda values, kind: f"element_at({literals([values.get(i, 1) for i in range(nodes)], kind)}, node + 1)"  # noqa: B023, E731
        of = lambda k: {i: t[k] for i, t in todo.items()}  # noqa: B023, E731
        key = f"element_at(array({', '.join(dims)}), {put({i: t[0] + 1 for i, t in todo.items()}, 'int')})"
        seen = at.filter(F.col("node").isin(list(todo))).select("node", "weight", F.expr(key).alias("key"), F.expr(put(of(1), "bigint")).alias("low"), F.expr(put(of(2), "bigint")).alias("high"), F.expr(put(step, "bigint")).alias("size"))
        sums: dict[int, list[tuple[int, int]]] = {i: [] for i in todo}
        for r in seen.filter("key >= low and key < high").groupBy("node", F.expr("(key - low) div size").alias("bin")).agg(F.sum("weight").alias("weight")).collect():
            sums[r.node].append((r.bin, r.weight))
        for i, (dim, lo, hi, left) in list(todo.items()):
            for b, w in sorted(sums[i]):
                if left < w:
                    break
                left -= w
            else:
                b, w = (hi - lo) // step[i], 0
            if step[i] == 1 or w == 0:  # one key: cut on the nearer side
                found.append((i, dim, lo + b * step[i] + (1 if left > w / 2 else 0)))
                del todo[i]
            else:
                todo[i] = (dim, lo + b * step[i], min(hi, lo + (b + 1) * step[i]), left)
    return found


def kd_tree(units: DataFrame, dims: list[str], shards: int, quota: list[float]) -> Tree:
    """A tree over units (weight, dims as keys) with a leaf for each shard."""
    tree = Tree(shards)
    while found := shards > 1 and len(tree.leaves()) < shards and cuts(units, tree, dims, quota):
        for i, dim, cut in found:
            tree.split(i, dim, cut)
        tree.depth += 1
    return tree


def settle(leaf: DataFrame, shards: int, heavy: dict[int, int], least: float) -> list[tuple[int, int, int, int]]:
    """(hash, crc, piece, shard) of the units that are to move, so that the shards' bytes are nearly equal. heavy: bytes of each shard that the tree didn't deal."""
    load = [heavy[s] for s in range(shards)]
    for r in leaf.groupBy("shard").agg(F.sum("weight").alias("weight")).collect():
        load[r.shard] += r.weight
    order = F.xxhash64("hash", "piece", F.lit(5))
    unit = F.struct("weight", "hash", "crc", "piece")
    some = leaf.groupBy("shard", F.floor(F.log2("weight")).alias("size"), F.pmod(order, F.lit(MOVABLE)).alias("of")).agg(F.min_by(unit, order).alias("unit")).collect()  # at most shards * 64 * MOVABLE rows
    free: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in range(shards)}
    for r in some:
        free[r["shard"]].append(tuple(r["unit"]))
    moved: dict[tuple[int, int, int], int] = {}
    while True:
        full, empty = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        # a unit goes over, against a lighter one or none
        back = [(0, 0, 0, 0), *sorted(free[empty])]
        weights = [u[0] for u in back]
        swaps = []
        for u in free[full]:
            at = bisect.bisect_left(weights, u[0] - gap / 2)
            swaps += [(abs(gap / 2 - (u[0] - v[0])), u, v) for v in back[max(0, at - 1) : at + 1] if 0 < u[0] - v[0] < gap]
        if gap <= least or not swaps:
            break
        _, u, v = min(swaps)
        for x, a, b in ((u, full, empty), (v, empty, full)):
            if x[0]:
                free[a].remove(x)
                free[b].append(x)
                load[a] -= x[0]
                load[b] += x[0]
                moved[x[1:]] = b
    return [(*k, s) for k, s in moved.items()]


def shard_documents(df: DataFrame, id_col: str, text_col: str, metadata: list[Column], shards: int = 24, overhead: int = 8) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    metadata: numeric expressions, the tree's dimensions; a group of equal texts takes its least
    values. Cases: a null text has `overhead` bytes and the checksum of the empty text; null
    metadata counts as 0; a null id is numbered first; repeated rows are rows of one group; an
    empty table gives no rows; further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [f"m{i}" for i in range(len(metadata))]
    rows = scratch.keep(
        df.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(m) for m, c in zip(own, metadata, strict=True)]),
        "shard-rows",
    )
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = total / shards

    # A hash shared by two texts only makes them one group.
    grouped = rows.groupBy("hash", "crc").agg(F.sum("size").alias("weight"), *[F.min(m).alias(m) for m in own])
    giants = [(r.hash, r.crc, math.ceil(r.weight / (PIECE * target))) for r in grouped.filter(F.col("weight") > (1 + SLACK) * target).collect()]  # fewer than `shards`
    piece = F.lit(0).cast("long")
    for h, c, n in giants:
        piece = F.when((F.col("hash") == h) & (F.col("crc") == c), F.pmod(F.xxhash64("id"), F.lit(n))).otherwise(piece)
    rows = rows.withColumn("piece", piece)
    units = rows.groupBy("hash", "crc", "piece").agg(F.sum("size").alias("weight"), *[F.min(m).alias(m) for m in own])
    units = scratch.keep(units, "shard-units")

    spread = units.agg(*[f(m) for m in own for f in (F.min, F.max)]).first()
    dims = [f"d{i}" for i in range(len(own))]
    keys = []
    for i, m in enumerate(own):
        lo, hi = spread[2 * i], spread[2 * i + 1]
        scaled = F.floor((F.col(m) - lo) / (hi - lo) * ((1 << 20) - 1)) if hi > lo else F.lit(0)
        keys.append((scaled.cast("long") * SPAN + F.pmod(F.xxhash64("hash", "piece", F.lit(i)), F.lit(SPAN))).alias(f"d{i}"))
    keyed = units.select("hash", "crc", "piece", "weight", *keys)

    large = keyed.filter(F.col("weight") > target).select("hash", "crc", "piece", "weight").collect()  # fewer than `shards`
    quota, placed = [target] * shards, []
    heap = [(0, s) for s in range(shards)]
    for r in sorted(large, key=lambda r: (-r.weight, r.hash, r.crc, r.piece)):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + r.weight, s))
        quota[s] = max(0.0, target - load - r.weight)
        placed.append((r.hash, r.crc, r.piece, s))

    light = keyed.filter(F.col("weight") <= target)
    tree = kd_tree(light, dims, shards, quota)
    leaf = light.select("hash", "crc", "piece", "weight", tree.place(dims).alias("n"))
    leaf = leaf.select("hash", "crc", "piece", "weight", F.expr(f"element_at({literals([lo for lo, _ in tree.span], 'int')}, n + 1)").alias("shard"))
    leaf = scratch.keep(leaf, "shard-leaves")
    heavy = {s: sum(r.weight for r, p in zip(sorted(large, key=lambda r: (-r.weight, r.hash, r.crc, r.piece)), placed, strict=True) if p[3] == s) for s in range(shards)}
    moved = settle(leaf, shards, heavy, EVEN * target)
    spark = df.sparkSession
    fixed = spark.createDataFrame([*placed, *moved], "hash long, crc long, piece long, to int")
    of_unit = keyed.select("hash", "crc", "piece").join(leaf.select("hash", "crc", "piece", "shard"), ["hash", "crc", "piece"], "left").join(F.broadcast(fixed), ["hash", "crc", "piece"], "left")  # at most `shards` rows and those that move
    of_unit = scratch.keep(of_unit.select("hash", "crc", "piece", F.coalesce("to", "shard").alias("shard")), "shard-of-unit")

    # Slots: runs of about RUN rows are counted, the counts summed up, the rows numbered by run.
    runs = max(64, math.ceil(count / shards / RUN))
    dealt = rows.join(of_unit, ["hash", "crc", "piece"]).select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "hash", F.lit(7)), F.lit(runs)).alias("run"))
    dealt = scratch.keep(dealt, "shard-dealt")
    before = run_offsets(dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")))
    return dealt.join(before, ["shard", "run"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("before") + F.row_number().over(W.partitionBy("shard", "run").orderBy("id", "crc", "size")) - 1).cast("long").alias("slot"),
    )


def run_offsets(counts: DataFrame) -> DataFrame:
    w = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("shard", "run", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
