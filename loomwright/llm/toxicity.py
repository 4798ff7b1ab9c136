"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams of GRAMS lengths, its ends marked, and of itself; each hashes
to one of BUCKETS embeddings. A word's vector is the mean of its bag, a text's vector the mean over
its words, and a softmax over two classes reads it. Embeddings and softmax are trained together.
A misspelt word shares most n-grams, and so most of its vector, with the word meant.

All n-grams are trained, but one that tells little of the labels is trusted less: its vector is
scaled down, so it learns slowly and texts aren't learnt by heart from rare words.

As the classifier is linear, a trained model scores by one number for each bucket: a text's logit
is the mean, over its words, of the means over their bags. All of a text's words count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm import arrow, kernel

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 100
#: Labelled texts that the driver trains on at most, and their bytes at most: the model is fitted on a bounded sample.
TRAIN_ROWS = 4_000
TRAIN_BYTES = 12 << 20
#: Bytes of texts whose features are worked out together.
TRAIN_SLICE = 1 << 19
SEED = 20_240_601
#: The chi-square from which a bucket is trusted in full, and the trust in one that tells nothing: its vector is scaled so, and learns as much slower.
CHI_SQUARE, LEAST_TRUST = 30.0, 0.01
#: Features worked on at a time.
STEP = 400_000
#: Means are this much longer than plain ones, for a word in a thousand to count.
SCALE = 100.0
RATE, DECAY = 0.05, 2e-5


class Model(NamedTuple):
    #: Class difference of each bucket's embedding, and of the bias.
    weight: np.ndarray
    bias: float


def bags(low: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): word i has buckets[first[i]:first[i + 1]]."""
    n, length = len(low), end - start
    up, down = kernel.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    parts, owners = [hashed], [np.arange(len(start))]
    for g in GRAMS:
        # marks count as one byte at either end: windows begin at -1 .. length + 1 - g
        count = np.maximum(0, length + 3 - g)
        word = np.repeat(np.arange(len(start)), count)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) - 1
        a, b = start[word] + np.maximum(nth, 0), start[word] + np.minimum(nth + g, length[word])
        head, tail = nth < 0, nth + g > length[word]
        h = (total[b] - total[a]) * down[a]
        parts.append(kernel.mix(h + np.uint64(g) + head.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + tail.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)))
        owners.append(word)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.searchsorted(owner[order], np.arange(len(start) + 1))


class Bag(NamedTuple):
    """Texts as words, each distinct word once: text t has words word[first[t]:first[t + 1]]."""

    word: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, bounds: np.ndarray) -> Bag:
        w = kernel.Words(raw, bounds, kernel.ALNUM)
        _, at, word = np.unique(w.hash, return_index=True, return_inverse=True)
        return cls(word, w.first, *bags(w.low, w.start[at], w.end[at], w.hash[at]))


def means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each run of numbers, summed up by itself and in order, so that it doesn't depend on its neighbours; 0 for an empty one."""
    size = np.diff(first)
    return np.bincount(np.repeat(np.arange(len(size)), size), values, len(size)) / np.maximum(size, 1)


def texts_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their weights in the mean) of each text, a slice of texts at a time."""
    for _, _, raw, bounds in kernel.slices(pa.array(texts, pa.string()), TRAIN_SLICE):
        bag = Bag.of(raw, bounds)
        size, words = np.diff(bag.within), np.diff(bag.first)
        for t in range(len(words)):
            word, count = np.unique(bag.word[bag.first[t] : bag.first[t + 1]], return_counts=True)
            n = size[word]
            part = np.repeat(count / (max(words[t], 1) * n), n)
            at = np.repeat(bag.within[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bucket, back = np.unique(bag.bucket[at], return_inverse=True)
            yield bucket, np.bincount(back, part, len(bucket))


def reliance(every: np.ndarray, ones: np.ndarray, n: int, positive: float) -> np.ndarray:
    """How far each bucket is trusted, LEAST_TRUST to 1, by the chi-square of its presence (in every[b] texts, ones[b] of label 1) and the label."""
    expected = every * positive / n
    spread = expected * (1 - positive / n) * (1 - every / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(spread > 0, (ones - expected) ** 2 / spread, 0.0)
    return np.clip((chi / CHI_SQUARE) ** 2, LEAST_TRUST, 1.0)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Full-batch Adam on log loss with decay. Without rows of both classes, the score is the share of label 1 (one half without rows)."""
    share = float(labels.mean()) if len(labels) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(labels) or share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), prior)
    found = [(b.astype(np.int32), v.astype(np.float32)) for b, v in texts_features(texts)]
    size = np.array([len(b) for b, _ in found])
    bucket, value = np.concatenate([b for b, _ in found]), np.concatenate([v for _, v in found]) * np.float32(SCALE)
    del found
    first = np.concatenate([[0], np.cumsum(size)])
    every = np.bincount(bucket, minlength=BUCKETS).astype(float)
    ones = np.bincount(bucket, np.repeat(labels, size), BUCKETS)
    trust = reliance(every, ones, len(labels), labels.sum()).astype(np.float32)
    used = np.flatnonzero(every)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    value *= trust[bucket]
    bucket = place[bucket]
    runs = [0]  # texts of about STEP features together
    while runs[-1] < len(labels):
        runs.append(max(runs[-1] + 1, int(np.searchsorted(first, first[runs[-1]] + STEP, "right")) - 1))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.01, (len(used), DIMENSIONS))
    soft = rng.normal(0, 0.3, (DIMENSIONS, 2))
    bias = np.array([0.0, prior])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, soft, bias)]
    rates = (RATE, RATE / 4, RATE)
    for t in range(1, epochs + 1):
        # the class difference is all that a softmax of two classes has; so one number for each bucket goes forwards and one back
        lean = e @ (soft[:, 1] - soft[:, 0])
        pull, missed = np.zeros(len(used)), 0.0
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            at, part, owner = bucket[first[a] : first[b]], value[first[a] : first[b]], np.repeat(np.arange(b - a), size[a:b])
            z = np.bincount(owner, lean[at] * part, b - a) + bias[1] - bias[0]
            dz = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[a:b]) / len(labels)
            pull += np.bincount(at, dz[owner] * part, len(used))
            missed += dz.sum()
        toward = e.T @ pull
        grads = (np.outer(pull, soft[:, 1] - soft[:, 0]) + DECAY * e, np.stack([-toward, toward], axis=1) + DECAY * soft, np.array([-missed, missed]))
        for x, g, (m, v), rate in zip((e, soft, bias), grads, state, rates, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros(BUCKETS)
    weight[used] = SCALE * trust[used] * (e @ (soft[:, 1] - soft[:, 0]))
    return Model(weight, float(bias[1] - bias[0]))


def logits(column: pa.Array, model: Model) -> np.ndarray:
    out = []
    for _, _, raw, bounds in kernel.slices(column):
        bag = Bag.of(raw, bounds)
        out.append(means(means(model.weight[bag.bucket], bag.within)[bag.word], bag.first) + model.bias)
    return np.concatenate(out) if out else np.empty(0)


def sample(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, held_out: int = 2) -> tuple[list[str], np.ndarray]:
    """The labelled rows outside the held-out quarter that come first by a hash of their id: at most `rows`, at most most_bytes of text.

    An id with several labels has the largest one. Sampling goes by labels first, so that only
    the chosen rows' texts reach the driver. Texts are whole.
    """
    known = labels.select(F.col(label_id).alias("_id"), F.col(label_col).alias("_label")).filter("_id is not null and _label is not null")
    known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != held_out).groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = F.broadcast(known.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(rows))  # at most `rows` rows
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    found = docs.join(chosen, "_id")
    sizes = found.groupBy("_id").agg(F.first("_order").alias("_order"), F.max(F.octet_length("_text")).alias("_size")).collect()
    left, fits = most_bytes, []
    for r in sorted(sizes, key=lambda r: (r["_order"], r["_id"])):
        if r["_size"] <= left:
            left -= r["_size"]
            fits.append((r["_id"],))
    if not fits:
        return [], np.array([])
    taken = F.broadcast(df.sparkSession.createDataFrame(fits, T.StructType([docs.schema["_id"]])))  # at most `rows` rows
    got = found.join(taken, "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")).collect()
    got.sort(key=lambda r: r["_id"])
    return [r["_text"] for r in got], np.array([r["_label"] for r in got], float)


def score(df: DataFrame, text_col: str, model: Model, score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) and score, the softmax's probability of label 1.

    Cases: a null or empty text, or one without words, scores as the bias alone; repeated rows
    score alike; an empty table stays empty; if df has score_col already, the new name gets an
    underscore.
    """
    at, name = df.columns.index(text_col), arrow.fresh(df, score_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-np.clip(logits(batch.column(at), shared.value), -500, 500))), pa.float64())]

    return arrow.add_columns(df, run, [T.StructField(name, T.DoubleType())], keep)
