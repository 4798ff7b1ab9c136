"""Text embeddings. No model is available offline: the hash embedding stands in, and any pandas UDF from text to array<float> may take its place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
#: Multiplier and increment of the congruential generator.
MULTIPLIER, INCREMENT = 6364136223846793005, 1


def hash_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Deterministic vector of length 1: a generator seeded by a hash of the text, each state's upper 31 bits brought to -1 .. 1."""
    state = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
    out = np.empty(dimensions)
    for i in range(dimensions):
        state = (state * MULTIPLIER + INCREMENT) % (1 << 64)
        out[i] = (state >> 33) / (0xFFFFFFFF / 2) - 1
    size = np.linalg.norm(out)
    return out / size if size else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Null counts as the empty text."""
    for s in texts:
        yield s.fillna("").map(lambda t: hash_vector(t).astype(np.float32).tolist())
