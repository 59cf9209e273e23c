"""What became of the messages of every batch.

A listener writes down what the stream observed of a batch (received, empty); the batch itself writes
what it stored, rejected and left out for a later message of the same posting. Together they account
for every message: received = saved + rejected + empty + replaced.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from pairwell.schemas import POSTING
from pairwell.sources.batches import read_batches, write_batch
from pairwell.sources.messages import posting_id, valid_messages

RECEIVED = T.StructType([T.StructField(name, T.LongType()) for name in ("received", "empty")])
STORED = T.StructType([T.StructField(name, T.LongType()) for name in ("saved", "rejected", "replaced")])


class BatchListener(StreamingQueryListener):
    """Writes the observed metric ``messages`` of every batch of the queries it hears of to ``status_path``.

    A batch that runs again after a restart replaces its row. Give ``name`` to hear one query only.
    Progress comes a little after the batch: ``wait`` for it before reading.
    """

    def __init__(self, spark: SparkSession, status_path: str, name: str | None = None):
        self.spark, self.path, self.name = spark, f"{status_path}/received", name
        self.lock, self.written, self.ended = threading.Condition(), set(), set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = progress.observedMetrics.get("messages")
        if observed is None or (self.name is not None and progress.name != self.name):
            return
        write_batch(self.spark.createDataFrame([(observed["received"], observed["empty"])], RECEIVED).coalesce(1), self.path, progress.batchId)
        with self.lock:
            self.written.add(progress.batchId)
            self.lock.notify_all()

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until all progress of an ended run is written: its end comes after it."""
        until = time.time() + seconds
        with self.lock:
            while run_id not in self.ended:
                if not self.lock.wait(max(0.0, until - time.time())):
                    raise TimeoutError(f"no end of run {run_id} after {seconds} s")


def write_stored(spark: SparkSession, status_path: str, batch_id: int, decoded: DataFrame, postings_path: str, rejects_path: str) -> None:
    """Count what a batch has written, and the messages that a later one of the same posting replaced."""
    valid = valid_messages(decoded).select(posting_id(F.col("link"), F.col("value")).alias("posting_id"))
    counts = valid.agg(F.count("*").alias("valid"), F.count_distinct("posting_id").alias("postings")).first()
    of_batch = F.col("batch_id") == batch_id
    saved = read_batches(spark, postings_path, POSTING).filter(of_batch).count()
    rejected = read_batches(spark, rejects_path, T.StructType([T.StructField("reason", T.StringType())])).filter(of_batch).count()
    row = (saved, rejected, counts["valid"] - counts["postings"])
    write_batch(spark.createDataFrame([row], STORED).coalesce(1), f"{status_path}/stored", batch_id)


def ingest_status(spark: SparkSession, status_path: str) -> DataFrame:
    """``(batch_id, received, empty, saved, rejected, replaced, missing)``; ``missing`` messages are unaccounted for."""
    received, stored = (read_batches(spark, f"{status_path}/{k}", s) for k, s in (("received", RECEIVED), ("stored", STORED)))
    both = received.join(stored, "batch_id", "full").fillna(0)
    missing = F.col("received") - F.col("empty") - F.col("saved") - F.col("rejected") - F.col("replaced")
    return both.select("batch_id", *RECEIVED.names, *STORED.names, missing.alias("missing"))
