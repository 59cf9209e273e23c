"""Flat token files and token counts from a separator scan.

``write_tokens`` writes each task's documents as one stream of little-endian ids, every
document followed by the end-of-document id, and cuts the stream into files of equal size
wherever that falls. The files have no index. ``token_counts`` finds the ends by vectorised
search in blocks, and stitches what crosses blocks and files: a prefix sum over the files of
a stream gives each file's first token and first document, a prefix maximum the end before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.llm.bpe import Encoder, Vocabulary, read_vocabulary
from pairwell.llm.common import kept

#: Tokens of a file, and tokens searched at once.
FILE_TOKENS = 1 << 22
BLOCK_TOKENS = 1 << 20
KINDS = {2: "<u2", 4: "<u4"}


class Stream:
    """Appends ids to numbered files of ``FILE_TOKENS`` tokens in a folder."""

    def __init__(self, folder: str, width: int, file_tokens: int, packed: bool):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.kind, self.file_tokens, self.packed = KINDS[width], file_tokens, packed
        self.number, self.room, self.file = 0, 0, None

    def write(self, ids: np.ndarray) -> None:
        while len(ids):
            if not self.room:
                self.close()
                if not self.number:
                    self.system.create_dir(self.folder, recursive=True)
                name = f"{self.folder}/{self.number:06d}.bin" + ".zst" * self.packed
                self.file = self.system.open_output_stream(name, compression="zstd" if self.packed else None)
                self.number, self.room = self.number + 1, self.file_tokens
            part = ids[: self.room]
            self.file.write(part.astype(self.kind).tobytes())
            self.room -= len(part)
            ids = ids[len(part) :]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 2,
    file_tokens: int = FILE_TOKENS,
    packed: bool = False,
) -> DataFrame:
    """Write the token files and return which document is which of a stream: (doc, stream, ordinal).

    ``folder`` must be reachable from all executors. A task that runs again writes a stream of
    its own; only streams that the returned table names belong to the data. Null texts have no
    ids, just their end. The strings of special tokens are ordinary text, so the end id stands
    for an end only. Rows keep their order within a stream; other columns are left out.
    ``packed`` stores each file compressed; read back, it is the same flat file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(sent.value)
        encoder, end = Encoder(words, specials=False), end_id(words)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        stream, ordinal = Stream(f"{folder.rstrip('/')}/{name}", width, file_tokens, packed), 0
        for batch in batches:
            held, size = [], 0
            for ids in encoder.encode(batch.column(1).to_pylist()):
                held += [ids, end]
                size += len(ids) + 1
                if size >= BLOCK_TOKENS:
                    stream.write(np.concatenate(held))
                    held, size = [], 0
            if held:
                stream.write(np.concatenate(held))
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n))],
                names=["doc", "stream", "ordinal"],
            )
            ordinal += n
        stream.close()

    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return kept(rows.mapInArrow(write, f"doc {id_type}, stream string, ordinal bigint"), "token-streams")


def end_id(words: Vocabulary) -> np.ndarray:
    """The end-of-document id: the file's first special token."""
    return np.array([min(words.special.values())], np.uint32)


def ends(ids: np.ndarray, end: int) -> np.ndarray:
    """Places of the end id, searched block by block."""
    found = [np.flatnonzero(ids[at : at + BLOCK_TOKENS] == end) + at for at in range(0, len(ids), BLOCK_TOKENS)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def token_counts(spark: SparkSession, folder: str, end: int, *, width: int = 2) -> DataFrame:
    """(stream, ordinal, first_token, n_tokens, ended) of every document in the files below a folder.

    A stream is a folder of files in the order of their names. What follows the last end of a
    stream is a document with ``ended`` false, if there is any. Files without an end, empty
    files and documents over many files are right; a folder without files gives no rows. Repeated
    documents count each for itself, as they lie in the files.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                if path.endswith(".zst"):
                    data = pa.input_stream(data, compression="zstd").read()
                ids = np.frombuffer(data, KINDS[width])
                places = ends(ids, end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.rsplit("/", 2)[1]]),
                        pa.array([path.rsplit("/", 1)[1]]),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([places], pa.list_(pa.int64())),
                    ],
                    names=["stream", "file", "tokens", "places"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin{,.zst}").load(folder)
    scanned = kept(files.select("path", "content").mapInArrow(scan, "stream string, file string, tokens bigint, places array<bigint>"), "token-ends")
    before = Window.partitionBy("stream").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # Prefix scan over the files of a stream: tokens and ends before a file, and the last end before it.
    located = scanned.withColumn("offset", F.coalesce(F.sum("tokens").over(before), zero)).withColumn(
        "first_ordinal", F.coalesce(F.sum(F.size("places")).over(before), zero)
    )
    last = F.when(F.size("places") > 0, F.col("offset") + F.element_at("places", -1))
    located = located.withColumn("last", last).withColumn("previous", F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")))
    each = located.select("stream", "offset", "first_ordinal", "previous", "places", F.posexplode("places").alias("k", "place"))
    start = F.when(F.col("k") == 0, F.col("previous")).otherwise(F.col("offset") + F.get("places", F.col("k") - 1)) + 1
    complete = each.select(
        "stream",
        (F.col("first_ordinal") + F.col("k")).alias("ordinal"),
        start.alias("first_token"),
        (F.col("offset") + F.col("place") - start).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    whole = located.groupBy("stream").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("places")).alias("ordinal"), F.max("last").alias("last"))
    begin = F.coalesce(F.col("last") + 1, zero)
    tail = whole.select("stream", "ordinal", begin.alias("first_token"), (F.col("tokens") - begin).alias("n_tokens"), F.lit(False).alias("ended"))
    return complete.unionByName(tail.filter("n_tokens > 0"))


def document_counts(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, n_tokens, stream, ordinal, first_token): the counts of the documents that ``write_tokens`` named."""
    return documents.join(counts.filter("ended"), ["stream", "ordinal"]).select("doc", "n_tokens", "stream", "ordinal", "first_token")
