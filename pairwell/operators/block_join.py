"""Score every profile against every posting without emitting the pairs.

The profile side of a search is the small one. While its measured size stays
under ``Limits.broadcast_bytes`` every task gets all of it and reads its own
postings once. Beyond that size the profiles are written once, in blocks of
bounded size, and every task streams the blocks past its postings, a buffer of
them at a time. Postings are not shuffled in either case. A search that counts its
profiles has what a task holds for each of them added to their size.

Several searches with kernels of their own share one pass (``best_of_each``). A
task scores Arrow batches with NumPy and keeps a running ``k`` best per profile
and search, so it emits at most ``profiles * k`` rows for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.operators.ranking import top_k
from pairwell.session import shared_dir

#: Digits to which a sum of products does not depend on its order.
NOISE_DIGITS = 12

#: Contenders held before they are merged, if twice the result is less.
MERGE_ROWS = 100_000
#: What one row of a profile's running best takes: two such are held, and copied while they are merged.
BEST_BYTES = 160


@dataclass(frozen=True)
class Limits:
    """Size bounds in bytes, scores a task holds at a time, and tasks whose results are ranked at once.

    Every task passes on its ``k`` best per profile; those of more tasks are ranked in two steps.
    """

    broadcast_bytes: int = 64 << 20
    block_bytes: int = 128 << 20
    scores: int = 1_000_000
    tasks: int = 20_000


Matches = tuple[np.ndarray, np.ndarray, np.ndarray]


class Kernel:
    """How one search scores a batch of postings."""

    def prepare(self, profiles: pa.Table) -> Any:
        """Lookup form of the profile side; has ``ids`` in row order."""
        raise NotImplementedError

    def encode(self, state: Any, postings: pa.RecordBatch) -> pa.RecordBatch:
        """Work done once per batch, before it is scored in slices."""
        return postings

    def matches(self, state: Any, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        """(profile row, posting row, score) of matches that reach their profile's floor.

        A kernel may leave out what can't be among the ``k`` best of a profile.
        """
        raise NotImplementedError


@dataclass(frozen=True)
class Search:
    """One ranked list: a kernel, its rows of the profiles, and the posting columns by the names the kernel knows.

    ``profile_bytes`` is a proven upper bound of the profile rows in bytes. ``held`` is how many profiles
    there are, if they may be very many, and ``held_bytes`` what the kernel's state takes of each.
    """

    source: str
    kernel: Kernel
    profiles: DataFrame
    profile_bytes: int
    columns: Mapping[str, str]
    held: int = 0
    held_bytes: int = 0

    def task_bytes(self, k: int) -> int:
        """Bytes of all profiles in a task: their rows, the kernel's state and the running best."""
        return self.profile_bytes + self.held * (self.held_bytes + k * BEST_BYTES)


def best_of_each(searches: Sequence[Search], postings: DataFrame, k: int, limits: Limits = Limits()) -> DataFrame:
    """Rows ``(cv_id, doc_id, source, score)`` holding every profile's ``k`` best postings of each search.

    One pass over the postings serves all searches. Each task contributes its own ``k`` best, so
    rank the result once more. Ties go to the smaller ``doc_id``.
    """
    source = T.StructField("source", T.StringType())
    schema = T.StructType([searches[0].profiles.schema["cv_id"], postings.schema["doc_id"], source, T.StructField("score", T.DoubleType())])
    found = _run(searches, postings, lambda search, state: _Best(search, state, k, limits.scores), schema, limits, k)
    if _scan_tasks(postings) <= limits.tasks:
        return found
    branch = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(limits.tasks))))
    return top_k(found.withColumn("branch", branch), ["cv_id", "source", "branch"], "score", "doc_id", k).drop("branch", "rank")


def match_counts(search: Search, postings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows ``(cv_id, candidates)``: how many postings each profile matched."""
    schema = T.StructType([search.profiles.schema["cv_id"], T.StructField("candidates", T.LongType())])
    partial = _run([search], postings, lambda s, state: _Counts(s, state, limits.scores), schema, limits, 0)
    return partial.groupBy("cv_id").agg(F.sum("candidates").alias("candidates"))


def id_bytes(name: str = "cv_id") -> Column:
    """Bytes of an id column of any type, as a bound."""
    return F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 8


def measured(df: DataFrame, row_bytes: Column) -> int:
    """Bytes of all rows together."""
    return counted(df, row_bytes)[0]


def counted(df: DataFrame, row_bytes: Column) -> tuple[int, int]:
    """Bytes of all rows together, and how many there are."""
    size, rows = df.agg(F.sum(row_bytes), F.count("*")).first()
    return size or 0, rows


#: Above this the planner does not know a size.
UNKNOWN_BYTES = 1 << 60


def _scan_tasks(postings: DataFrame) -> int:
    """Tasks of a scan of the postings, by the size that the planner knows; 0 if it knows none."""
    size = int(str(postings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = postings.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return 0 if size > UNKNOWN_BYTES else size // part + 1


Start = Callable[[Search, Any], "_Running"]


def _run(searches: Sequence[Search], postings: DataFrame, start: Start, schema: T.StructType, limits: Limits, k: int) -> DataFrame:
    spark = postings.sparkSession
    stored = postings.select("doc_id", *dict.fromkeys(c for s in searches for c in s.columns.values()))
    # Data frames stay on the driver.
    parts = [Search(s.source, s.kernel, None, s.profile_bytes, dict(s.columns)) for s in searches]
    if sum(s.task_bytes(k) for s in searches) <= limits.broadcast_bytes:
        shared = spark.sparkContext.broadcast([s.profiles.toArrow() for s in searches])

        def over_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            running = [start(s, s.kernel.prepare(rows)) for s, rows in zip(parts, shared.value)]
            for batch in batches:
                for one in running:
                    one.add(batch)
            for one in running:
                yield from one.result()

        return stored.mapInArrow(over_partition, schema)

    blocks = [_written(s, s.task_bytes(k), limits.block_bytes) for s in searches]

    def over_buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _buffers(batches, limits.block_bytes):
            for search, files in zip(parts, blocks):
                for file in files:
                    store, path = fs.FileSystem.from_uri(file)
                    one = start(search, search.kernel.prepare(pq.read_table(path, filesystem=store)))
                    for batch in buffer:
                        one.add(batch)
                    yield from one.result()

    return stored.mapInArrow(over_buffers, schema)


def _written(search: Search, task_bytes: int, block_bytes: int) -> list[str]:
    """Files of the profile rows, each about a block; all rows of a profile lie in one file."""
    path = shared_dir(search.profiles.sparkSession, "profile-blocks")
    search.profiles.repartition(max(1, math.ceil(task_bytes / block_bytes)), "cv_id").write.parquet(path)
    return search.profiles.sparkSession.read.schema(search.profiles.schema).parquet(path).inputFiles()


def _buffers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield held
            held, held_bytes = [], 0
    if held:
        yield held


class _Running:
    """A search over one task's postings."""

    def __init__(self, search: Search, state: Any, scores: int):
        self.search, self.kernel, self.state, self.profiles = search, search.kernel, state, len(state.ids)
        self.step = max(1, scores // max(1, self.profiles))
        self.floor = np.full(self.profiles, -np.inf)

    def add(self, batch: pa.RecordBatch) -> None:
        if not self.profiles:
            return
        names = ["doc_id", *self.search.columns]
        columns = [batch.column(c) for c in ("doc_id", *self.search.columns.values())]
        own = self.kernel.encode(self.state, pa.RecordBatch.from_arrays(columns, names=names))
        for start in range(0, own.num_rows, self.step):
            self.take(own.slice(start, self.step))

    def take(self, chunk: pa.RecordBatch) -> None:
        raise NotImplementedError

    def result(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Best(_Running):
    def __init__(self, search: Search, state: Any, k: int, scores: int):
        super().__init__(search, state, scores)
        self.k, self.held = k, []
        self.room = self.merge_rows = max(MERGE_ROWS, 2 * k * self.profiles)

    def take(self, chunk: pa.RecordBatch) -> None:
        row, column, score = self.kernel.matches(self.state, chunk, self.floor, self.k)
        if len(row) == 0:
            return
        self.held.append(pa.table({"row": row, "doc_id": chunk.column("doc_id").take(pa.array(column)), "score": score}))
        self.room -= len(row)
        if self.room <= 0:
            self.held, self.room = [_merged(self.held, self.floor, self.k)], self.merge_rows

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            best = _merged(self.held, self.floor, self.k)
            ids = self.state.ids.take(best["row"].combine_chunks())
            source = pa.array([self.search.source] * len(ids), pa.string())
            table = pa.table({"cv_id": ids, "doc_id": best["doc_id"], "source": source, "score": best["score"]})
            yield from table.combine_chunks().to_batches()


class _Counts(_Running):
    def __init__(self, search: Search, state: Any, scores: int):
        super().__init__(search, state, scores)
        self.total = np.zeros(self.profiles, dtype=np.int64)

    def take(self, chunk: pa.RecordBatch) -> None:
        row, _, _ = self.kernel.matches(self.state, chunk, self.floor, chunk.num_rows)
        self.total += np.bincount(row, minlength=self.profiles)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.profiles:
            yield pa.RecordBatch.from_pydict({"cv_id": self.state.ids, "candidates": self.total})


def _merged(held: list[pa.Table], floor: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best per profile of what is held; raises each profile's floor to its k-th score."""
    rows = pa.concat_tables(held)
    rows = rows.filter(pa.array(rows["score"].to_numpy() >= floor[rows["row"].to_numpy()]))
    rows = rows.sort_by([("row", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    order = rows["row"].to_numpy()
    begins = np.r_[True, order[1:] != order[:-1]][: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    last = place == k - 1
    floor[order[last]] = rows["score"].to_numpy()[last]
    return rows.filter(pa.array(place < k))


def reaching(row: np.ndarray, column: np.ndarray, score: np.ndarray, floor: np.ndarray) -> Matches:
    """The matches that reach their profile's floor."""
    keep = score >= floor[row]
    return row[keep], column[keep], score[keep]


def contenders(score: np.ndarray, floor: np.ndarray, k: int, ids: pa.Array) -> Matches:
    """Cells of a full matrix that can still be among a profile's ``k`` best: at most ``2 k`` per profile.

    Many equal scores (copies of one posting) are cut by id, as the ranking does; -inf is no match.
    """
    matched = score > -np.inf
    keep = matched & (score >= floor[:, None])
    width = score.shape[1]
    if width <= k or np.count_nonzero(keep) <= 2 * k * len(score):
        row, column = np.nonzero(keep)
        return row, column, score[row, column]
    by_id = pc.sort_indices(ids).to_numpy()
    ordered = score[:, by_id]
    bar = np.maximum(floor, np.partition(ordered, width - k, axis=1)[:, width - k])[:, None]
    tied = (ordered == bar) & (bar > -np.inf)
    row, place = np.nonzero((ordered > bar) | (tied & (np.cumsum(tied, axis=1) <= k)))
    return row, by_id[place], ordered[row, place]


def flat_ids(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def fixed_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as a matrix; unequal lengths are an error."""
    column = flat_ids(column)
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    width = int(lengths[0]) if len(lengths) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def rounded(score: np.ndarray, digits: int | None) -> np.ndarray:
    """Non-negative scores to some digits, halves up, as SQL does.

    Without ``digits`` only what is left of the order of additions goes, so that copies tie.
    """
    unit = 10.0 ** (NOISE_DIGITS if digits is None else digits)
    return np.floor(score * unit + 0.5) / unit
