"""Vector expressions and the numpy kernels that tasks run on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from postsift.functions.text import col_of


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in DOUBLE; 0 when either vector has no length."""
    a, b = col_of(a), col_of(b)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def has_length(v: Column | str) -> Column:
    """True for a non-null vector with at least one non-zero element."""
    return F.coalesce(F.exists(col_of(v), lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Stack a pandas column of vectors, or take a matrix, to a matrix with rows of length one."""
    matrix = vectors if isinstance(vectors, np.ndarray) else np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    """Random hyperplanes; the seed makes every task draw the same ones."""
    return np.random.default_rng(seed).standard_normal((dim, count))


def agree_probability(tau: float) -> float:
    """Chance that two vectors with cosine *tau* fall on the same side of a random plane."""
    return 1.0 - math.acos(tau) / math.pi


def bands_for(tau: float, bits: int, recall: float) -> int:
    """Bands of *bits* planes needed to meet a pair at *tau* in one band at least, with this chance."""
    hit = agree_probability(tau) ** bits
    return max(1, math.ceil(math.log(1.0 - recall) / math.log1p(-hit)))


def most_signs_apart(tau: float, signs: int, miss: float) -> int:
    """Of *signs* random planes, so many have a pair at *tau* on different sides at most, but for the chance *miss*."""
    differ = 1.0 - agree_probability(tau)
    beyond = 0.0
    for apart in range(signs, 0, -1):
        beyond += math.comb(signs, apart) * differ**apart * (1.0 - differ) ** (signs - apart)
        if beyond > miss:
            return apart
    return 0
