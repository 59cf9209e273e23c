"""MinHash signatures and their band layout."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.text import normal_tokens
from pairwell.operators.hashing import hashed_tokens, some_at_a_time

# Sketch size and search threshold, and the public parameters of
# the hash family (a*x + b) mod p, cut to 32 bits, with seeded a and b.
NUM_PERM = 128
THRESHOLD = 0.05
SEED = 1
MERSENNE_61 = (1 << 61) - 1
MAX_HASH = (1 << 32) - 1


@lru_cache
def permutations(num_perm: int = NUM_PERM, seed: int = SEED) -> np.ndarray:
    """Multipliers and offsets, one row per signature position."""
    draw = np.random.RandomState(seed)
    pairs = [
        (
            draw.randint(1, MERSENNE_61, dtype=np.uint64),
            draw.randint(0, MERSENNE_61, dtype=np.uint64),
        )
        for _ in range(num_perm)
    ]
    return np.array(pairs, dtype=np.uint64)


def _mod_mersenne_61(x: np.ndarray) -> np.ndarray:
    prime = np.uint64(MERSENNE_61)
    folded = (x & prime) + (x >> np.uint64(61))
    return np.where(folded >= prime, folded - prime, folded)


def signature(tokens: Column, num_perm: int = NUM_PERM, seed: int = SEED) -> Column:
    """Signature of each row's tokens; an empty or null list gives all maxima.

    The tokens of a posting sit in its own row, so this is a projection: no
    explode and no shuffle.
    """
    pairs = permutations(num_perm, seed)

    def least(lists: pa.Array) -> pa.Array:
        lengths, codes, hashes = hashed_tokens(lists)
        out = np.full((len(lists), num_perm), MAX_HASH, dtype=np.int64)
        filled = np.flatnonzero(lengths)
        if len(filled):
            starts = (np.cumsum(lengths) - lengths)[filled]
            for position, (a, b) in enumerate(pairs):
                mixed = (_mod_mersenne_61(a * hashes + b) & np.uint64(MAX_HASH)).astype(np.uint32)
                out[filled, position] = np.minimum.reduceat(mixed[codes], starts)
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * num_perm
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def minima(lists: pa.Array) -> pa.Array:
        return some_at_a_time(lists, least)

    return minima(tokens)


def skills_signature(skills: Column, num_perm: int = NUM_PERM, seed: int = SEED) -> Column:
    """Signature of a skill list, case and outer white space ignored."""
    return signature(normal_tokens(skills), num_perm, seed)


@lru_cache
def optimal_bands(threshold: float = THRESHOLD, num_perm: int = NUM_PERM) -> tuple[int, int]:
    """Bands and rows per band with the least false-positive plus false-negative area."""
    step = 1e-3
    grid = np.arange(step / 2, 1.0, step)
    below = grid < threshold
    best = (np.inf, 1, 1)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            hit = 1.0 - (1.0 - grid**rows) ** bands
            error = 0.5 * step * (hit[below].sum() + (1.0 - hit[~below]).sum())
            if error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]


def band_table(
    sketches: DataFrame,
    id_column: str = "doc_id",
    signature_column: str = "signature",
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
) -> DataFrame:
    """Rows ``(id, band, bucket)``: the bucket is the band's signature slice as text."""
    bands, rows = optimal_bands(threshold, num_perm)
    slices = [
        F.array_join(F.slice(signature_column, band * rows + 1, rows).cast("array<string>"), "-")
        for band in range(bands)
    ]
    return sketches.select(id_column, F.posexplode(F.array(*slices)).alias("band", "bucket"))
