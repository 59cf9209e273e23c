"""Exact vector search that skips postings by angles to pivots.

The index groups postings around pivots: each lies with the pivot it makes the smallest angle
with, and keeps that angle. Angles obey the triangle inequality, so for a profile q and a
posting x of pivot p, ``angle(q, x) >= |angle(q, p) - angle(x, p)|``. Where that is more than
the angle of the profile's floor, x can't be among its k best.

Pivots are postings themselves: the k-th best of them is a floor that holds before the first
posting is scored. Floors rise as a task goes on. Groups that no profile can reach are left out
of the scan; in a group, a task scores only the rows and the profiles that are left. Results
are those of ``vector_topk``.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.operators.block_join import (
    NOISE_DIGITS,
    Limits,
    Matches,
    Search,
    best_of_each,
    contenders,
    fixed_matrix,
    match_counts,
    reaching,
    rounded,
)
from pairwell.operators.ranking import as_channel
from pairwell.operators.vector import CosineKernel, unit_rows, vector_search

#: Pivots at most: they are held by the driver and every task.
PIVOTS = 1024
#: What a task takes for the angle of a profile to a pivot: it, its cosine and their copies.
ANGLE_BYTES = 32
#: Pairs whose vectors are held side by side.
PAIRS = 16_384
#: Scores this near to a floor are not skipped: angles are computed in another way than scores.
MARGIN = 2e-6


def write_pivot_index(postings: DataFrame, path: str, pivots: int | None = None, vector: str = "vector") -> int:
    """Write postings ``(doc_id, vector)`` around pivots; returns how many pivots there are.

    The pivots are the postings with the smallest MD5 of their id, about the square root of all, ``PIVOTS`` at
    most. Null and zero vectors stand for no text and are left out. Rows are range-partitioned by pivot
    and angle, so a pivot that very many postings are near to spreads over several files.
    """
    rows = postings.select("doc_id", F.col(vector).alias("vector"))
    usable = rows.filter(F.exists("vector", lambda x: x != 0))
    if pivots is None:
        pivots = min(PIVOTS, int(usable.count() ** 0.5) + 1)
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = usable.withColumn("digest", digest).orderBy("digest", "doc_id").limit(pivots).select("doc_id", "vector")
    chosen.coalesce(1).write.parquet(f"{path}/pivots")
    centres = postings.sparkSession.read.schema(rows.schema).parquet(f"{path}/pivots").toArrow()
    shared = postings.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        _, units = unit_rows(shared.value.column("vector").combine_chunks())
        for batch in batches:
            present, own = unit_rows(batch.column("vector"))
            if not len(present):
                continue
            cosine = own @ units.T
            nearest = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(own)), nearest], -1, 1))
            left = batch.take(pa.array(present))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(nearest.astype(np.int32)), pa.array(angle)], names=["doc_id", "vector", "pivot", "angle"])

    schema = T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    around = usable.mapInArrow(assign, schema)
    around.repartitionByRange("pivot", "angle").sortWithinPartitions("pivot", "angle").write.parquet(f"{path}/rows")
    return centres.num_rows


class PivotKernel(CosineKernel):
    """Cosine + 1 of the rows that a profile can reach; the others are no match."""

    def __init__(self, centres: pa.Table, k: int, digits: int | None = None):
        super().__init__(digits)
        self.centres, self.k = centres, k

    def prepare(self, profiles: pa.Table) -> SimpleNamespace:
        state = super().prepare(profiles)
        _, units = unit_rows(self.centres.column("vector").combine_chunks())
        cosine = state.units @ units.T if len(state.ids) and len(units) else np.zeros((len(state.ids), len(units)))
        state.least = np.full(len(state.ids), -np.inf)
        if self.k <= cosine.shape[1]:
            kth = np.partition(cosine, cosine.shape[1] - self.k, axis=1)[:, cosine.shape[1] - self.k]
            state.least = rounded(kth + 1.0, self.digits)
        # The angles to one pivot are read together.
        state.angles = np.asfortranarray(np.clip(cosine, -1, 1))
        np.arccos(state.angles, out=state.angles)
        state.single = state.units.astype(np.float32)
        return state

    def reachable(self, state: SimpleNamespace, floor: np.ndarray) -> np.ndarray:
        """Largest angle of a posting that reaches each profile's floor."""
        unit = 10.0 ** -(NOISE_DIGITS if self.digits is None else self.digits)
        return np.arccos(np.clip(np.maximum(state.least, floor) - 1 - unit - MARGIN, -1, 1))

    def matches(self, state: SimpleNamespace, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        pivot, angle = postings.column("pivot").to_numpy(), postings.column("angle").to_numpy()
        bar, reach = np.maximum(floor, state.least), self.reachable(state, floor)
        vectors = fixed_matrix(postings.column("vector")).astype(np.float64)
        units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        # Cosines in single precision are this near to those in double precision, which alone make scores.
        unit = 10.0 ** -(NOISE_DIGITS if self.digits is None else self.digits)
        least = (bar - 1 - unit - (units.shape[1] + 8) * 2.0**-23).astype(np.float32)
        found: list[Matches] = []
        begins = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]) if len(pivot) else np.zeros(0, np.int64)
        for a, b in zip(begins, np.r_[begins[1:], len(pivot)]):
            to_pivot = state.angles[:, pivot[a]]
            nearest, farthest = to_pivot - reach, to_pivot + reach
            near = (nearest <= angle[a:b].max()) & (farthest >= angle[a:b].min())
            row = np.flatnonzero(near)
            if not len(row):
                continue
            column = a + np.flatnonzero((angle[a:b] >= nearest[row].min()) & (angle[a:b] <= farthest[row].max()))
            # All profiles, as where nothing can be skipped, need no copy.
            row = slice(None) if len(row) == len(near) else row
            hit = state.single[row] @ units[column].astype(np.float32).T >= least[row, None]
            found.append(self.scored(state, row, column, hit, units, bar, k, postings.column("doc_id")))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(part) for part in zip(*found))

    def scored(self, state: SimpleNamespace, row, column: np.ndarray, hit: np.ndarray, units: np.ndarray, bar: np.ndarray, k: int, ids: pa.Array) -> Matches:
        """The hits of some profiles and postings that reach their floor; of very many, those that can stay."""
        rows = np.arange(len(state.ids))[row]
        place = np.flatnonzero(hit)
        if len(place) > 2 * k * len(rows):
            score = np.where(hit, rounded(state.units[row] @ units[column].T + 1.0, self.digits), -np.inf)
            own, other, score = contenders(score, bar[row], k, ids.take(pa.array(column)))
            return rows[own], column[other], score
        own, other = np.divmod(place, max(1, len(column)))
        own, other, score = rows[own], column[other], np.empty(len(place))
        for start in range(0, len(place), PAIRS):
            part = slice(start, start + PAIRS)
            score[part] = np.einsum("ij,ij->i", state.units[own[part]], units[other[part]])
        return reaching(own, other, rounded(score + 1.0, self.digits), bar)


class ReachKernel(PivotKernel):
    """The rows that the bound leaves a profile, before any floor has risen."""

    def matches(self, state: SimpleNamespace, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        pivot, angle = postings.column("pivot").to_numpy(), postings.column("angle").to_numpy()
        reach = self.reachable(state, np.full(len(state.ids), -np.inf))
        row, column = np.nonzero(np.abs(state.angles[:, pivot] - angle) <= reach[:, None])
        return row, column, np.zeros(len(row))


def pivot_topk(
    spark: SparkSession,
    path: str,
    profiles: DataFrame,
    k: int,
    profile_vector: str = "vector",
    source: str = "sem_vector",
    limits: Limits = Limits(),
    digits: int | None = None,
) -> DataFrame:
    """As ``vector_topk`` over the postings of an index, skipping what can't be among the ``k`` best."""
    search, rows = _searched(spark, path, profiles, k, profile_vector, source, PivotKernel, limits, digits)
    return as_channel(best_of_each([search], rows, k, limits), k)


def pivot_reach(
    spark: SparkSession, path: str, profiles: DataFrame, k: int, profile_vector: str = "vector", limits: Limits = Limits(), digits: int | None = None
) -> DataFrame:
    """``(cv_id, candidates)``: postings that the first floors leave to score, of all in the index."""
    search, rows = _searched(spark, path, profiles, k, profile_vector, "reach", ReachKernel, limits, digits)
    return match_counts(search, rows, limits)


def _searched(spark, path, profiles, k, profile_vector, source, kernel_class, limits, digits) -> tuple[Search, DataFrame]:
    rows = spark.read.parquet(f"{path}/rows")
    centres = spark.read.parquet(f"{path}/pivots").toArrow()
    search = vector_search(profiles, profile_vector, "vector", source, digits)
    kernel = kernel_class(centres, k, digits)
    columns = {"vector": "vector", "pivot": "pivot", "angle": "angle"}
    # A profile has its angle to every pivot, and copies of them on the way.
    held_bytes = search.held_bytes + ANGLE_BYTES * centres.num_rows
    search = Search(source, kernel, search.profiles, search.profile_bytes, columns, search.held, held_bytes)
    if search.task_bytes(k) > limits.broadcast_bytes:
        return search, rows
    # Groups that no profile reaches are not read.
    state = kernel.prepare(search.profiles.toArrow())
    groups = rows.groupBy("pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    reach = kernel.reachable(state, np.full(len(state.ids), -np.inf))
    near = [
        g["pivot"] for g in groups
        if ((state.angles[:, g["pivot"]] - reach <= g["high"]) & (state.angles[:, g["pivot"]] + reach >= g["low"])).any()
    ]
    return search, rows if len(near) == len(groups) else rows.filter(F.col("pivot").isin(near))
