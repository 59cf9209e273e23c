"""Bulk writes to a store outside Spark, with the rows it refuses.

A caller's function takes a list of (id, document) and returns the reasons for those it refused, by
id. Tasks send their rows in chunks through a Spark data source. What a task has to report lies in a
file of its own attempt; the files of the attempts that Spark commits are named in one list per batch, so a
retried task reports once. The store itself must replace a document that comes again under its id.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pairwell.sources.compaction import Folder, numbers

#: Called once per task; returns a function from (id, document) pairs to the reasons of the refused ones by id.
OpenSink = Callable[[], Callable[[list[tuple[str, str]]], dict[str, str]]]

REFUSED = T.StructType([T.StructField("id", T.StringType()), T.StructField("document", T.StringType()), T.StructField("reason", T.StringType())])
COMMITTED = "_committed.json"


@dataclass
class Sent(WriterCommitMessage):
    """What one attempt of a task has sent, and the file of what was refused."""

    saved: int
    refused: int
    file: str | None


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class BulkWriter(DataSourceArrowWriter):
    def __init__(self, open_sink: OpenSink, folder: str, chunk: int, tries: int, pause: float):
        self.open_sink, self.folder, self.chunk, self.tries, self.pause = open_sink, folder, chunk, tries, pause

    def send(self, sink, rows: list[tuple[str, str]]) -> dict[str, str]:
        """Reasons by id; a chunk on which the store itself fails is tried again, and refused as a whole in the end."""
        for left in range(self.tries - 1, -1, -1):
            try:
                return sink(rows) or {}
            except Exception as failure:
                if not left:
                    return dict.fromkeys((i for i, _ in rows), f"store: {failure or type(failure).__name__}")
                time.sleep(self.pause)
        return {}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        sink, saved, refused, file, writer = self.open_sink(), 0, 0, None, None
        schema = pa.schema([(name, pa.string()) for name in REFUSED.names])
        try:
            for batch in iterator:
                ids, documents = batch.column("id").to_pylist(), batch.column("document").to_pylist()
                for at in range(0, len(ids), self.chunk):
                    rows = list(zip(ids[at : at + self.chunk], documents[at : at + self.chunk]))
                    reasons = self.send(sink, rows)
                    failed = [(i, d, reasons[i]) for i, d in rows if i in reasons]
                    saved, refused = saved + len(rows) - len(failed), refused + len(failed)
                    if failed:
                        if writer is None:
                            store, path = _open(self.folder)
                            store.create_dir(path)
                            file = f"{uuid.uuid4().hex}.parquet"
                            writer = pq.ParquetWriter(f"{path}/{file}", schema, filesystem=store)
                        writer.write_table(pa.table([pa.array(c, pa.string()) for c in zip(*failed)], schema=schema))
        finally:
            if writer is not None:
                writer.close()
        return Sent(saved, refused, file)

    def commit(self, messages: list[Sent | None]) -> None:
        told = [m for m in messages if m is not None]
        store, path = _open(self.folder)
        store.create_dir(path)
        whole = {"saved": sum(m.saved for m in told), "refused": sum(m.refused for m in told), "files": [m.file for m in told if m.file]}
        with store.open_output_stream(f"{path}/{COMMITTED}") as out:
            out.write(json.dumps(whole).encode())


def bulk_write(
    documents: DataFrame, open_sink: OpenSink, path: str, batch_id: int = 0, chunk: int = 500, tries: int = 3, pause: float = 1.0
) -> None:
    """Send ``documents(id, document)`` to a store; what it refuses is reported under ``path``.

    Sending a batch again replaces its report.
    """
    folder = f"{path}/batch_id={batch_id}"
    writer = BulkWriter(open_sink, folder if "://" in folder else f"file://{folder}", chunk, tries, pause)

    class BulkSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pairwell_bulk"

        def writer(self, schema, overwrite):
            return writer

    documents.sparkSession.dataSource.register(BulkSink)
    documents.select("id", "document").write.format("pairwell_bulk").mode("append").save()


def _reports(spark: SparkSession, path: str) -> Iterator[tuple[int, str, dict]]:
    for batch in numbers(Folder(spark, path).names(), "batch_id="):
        folder = f"{path}/batch_id={batch}"
        if Folder(spark, f"{folder}/{COMMITTED}").exists():
            yield batch, folder, json.loads(Folder(spark, f"{folder}/{COMMITTED}").text())


def bulk_refused(spark: SparkSession, path: str) -> DataFrame:
    """``(id, document, reason)`` of what was refused in all batches."""
    files = [f"{folder}/{name}" for _, folder, report in _reports(spark, path) for name in report["files"]]
    return spark.read.schema(REFUSED).parquet(*files) if files else spark.createDataFrame([], REFUSED)


def bulk_status(spark: SparkSession, path: str) -> DataFrame:
    """``(batch_id, saved, refused)`` of every batch."""
    rows = [(batch, report["saved"], report["refused"]) for batch, _, report in _reports(spark, path)]
    return spark.createDataFrame(rows, "batch_id long, saved long, refused long")
