"""Exact vector search."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.operators.block_join import (
    Kernel,
    Limits,
    Matches,
    Search,
    best_of_each,
    contenders,
    counted,
    fixed_matrix,
    flat_ids,
    id_bytes,
    rounded,
)
from pairwell.operators.ranking import as_channel


class CosineKernel(Kernel):
    """Cosine + 1 as one matrix product per batch."""

    def __init__(self, digits: int | None = None):
        self.digits = digits

    def prepare(self, profiles: pa.Table) -> SimpleNamespace:
        usable, units = unit_rows(flat_ids(profiles.column("vector")))
        ids = flat_ids(profiles.column("cv_id")).take(pa.array(usable))
        return SimpleNamespace(ids=ids, units=units)

    def matches(self, state: SimpleNamespace, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        usable, units = unit_rows(postings.column("vector"))
        score = np.full((len(state.ids), postings.num_rows), -np.inf)
        if len(usable) and len(state.ids):
            if units.shape[1] != state.units.shape[1]:
                raise ValueError(f"vectors of different lengths: {state.units.shape[1]}, {units.shape[1]}")
            score[:, usable] = rounded(state.units @ units.T + 1.0, self.digits)
        return contenders(score, floor, k, postings.column("doc_id"))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the rows they come from.

    Null and all-zero vectors stand for "no text" and are left out here, in the
    task: a Spark filter on them would compute an inline embedding twice.
    """
    present = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    vectors = fixed_matrix(column.drop_null()).astype(np.float64)
    length = np.linalg.norm(vectors, axis=1)
    usable = np.flatnonzero(length > 0)
    return present[usable], vectors[usable] / length[usable, None]


def vector_search(
    profiles: DataFrame, profile_vector: str, posting_vector: str, source: str, digits: int | None = None
) -> Search:
    """Search for the postings nearest to every profile by cosine."""
    asked = profiles.select("cv_id", F.col(profile_vector).alias("vector"))
    size, rows = counted(asked, F.coalesce(F.size("vector"), F.lit(0)) * 4 + 16 + id_bytes())
    # Unit vectors in double precision, and a copy on the way to them.
    return Search(source, CosineKernel(digits), asked, size, {"vector": posting_vector}, rows, 4 * size // max(1, rows))


def vector_topk(
    profiles: DataFrame,
    postings: DataFrame,
    k: int,
    profile_vector: str = "vector",
    posting_vector: str = "vector",
    source: str = "sem_vector",
    limits: Limits = Limits(),
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` postings nearest to every profile by cosine; ``digits`` rounds scores before they rank."""
    search = vector_search(profiles, profile_vector, posting_vector, source, digits)
    return as_channel(best_of_each([search], postings, k, limits), k)
