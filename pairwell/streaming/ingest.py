"""Message stream into the postings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairwell.operators.embed import DIM, Embedder
from pairwell.plans.enrich import enrich
from pairwell.schemas import POSTING
from pairwell.sources.messages import decode_messages, last_per_posting, rejected_messages, valid_messages
from pairwell.sources.batches import CODEC, read_batches, write_batch
from pairwell.sources.compaction import Folder
from pairwell.sources.search_index import write_index
from pairwell.sources.vectors import VectorStore
from pairwell.streaming.status import write_stored

#: Of a row group of raw messages, as they are buffered, which is mostly compressed. Spark's reader holds 4,096 rows at a time,
#: but no more than a row group: with long messages that is much less.
ROW_GROUP_BYTES = 2 << 20

REJECT = T.StructType([T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())])


def store_batch(
    messages: DataFrame,
    postings_path: str,
    rejects_path: str,
    batch_id: int,
    order: Sequence[str],
    embedder: Embedder | None = None,
    dim: int = DIM,
    tasks: int | None = None,
    on_error: str = "raise",
    index_path: str | None = None,
    store: VectorStore | None = None,
    status_path: str | None = None,
) -> None:
    """Decode, enrich and store one batch; bad messages go to the rejects.

    Storing the same batch again rewrites its folder, so nothing is lost or
    repeated. ``order`` names the columns by which the last message of a posting
    wins. The batch's messages are kept in a hidden folder beside the rejects until it is stored.
    ``tasks`` spreads the raw messages if they lie in fewer splits, for sources with few partitions.
    ``on_error`` is that of the embedder; its rejects join the others. With ``index_path`` the
    stored rows are indexed (``search_index.write_index``). ``store`` keeps the model's vectors across
    batches. With ``status_path`` the batch leaves a row of what became of its messages.
    """
    spark, columns = messages.sparkSession, list(dict.fromkeys(["value", *order]))
    # The raw messages are written, and decoded by whatever reads them: decoded, they take many times as much.
    kept = Folder(spark, f"{rejects_path}/_messages-{batch_id}")
    try:
        _keep(messages.select(*columns).filter(F.col("value") != ""), kept.path)
        raw = spark.read.schema(messages.select(*columns).schema).parquet(kept.path)
        if tasks is not None and raw.rdd.getNumPartitions() < tasks:
            raw = raw.repartition(tasks)
        decoded = decode_messages(raw)
        # Only raw messages are compared, and moved where an id comes again.
        last = last_per_posting(valid_messages(decoded).select(*columns, "link"), order)
        good = valid_messages(decode_messages(last.select(*columns)))
        rows, rejects = enrich(good, embedder, dim, on_error=on_error, store=store), rejected_messages(decoded)
        if on_error == "reject":
            failed = rows.filter("embed_error IS NOT NULL")
            rejects = rejects.unionByName(failed.select("value", F.concat(F.lit("embedder: "), "embed_error").alias("reason")))
            rows = rows.filter("embed_error IS NULL")
        write_batch(rows.select(*POSTING.names), postings_path, batch_id)
        write_batch(rejects, rejects_path, batch_id)
        if index_path is not None:
            stored = read_batches(spark, postings_path, POSTING).filter(F.col("batch_id") == batch_id)
            write_index(stored.drop("batch_id"), index_path, batch_id)
        if status_path is not None:
            write_stored(spark, status_path, batch_id, decoded, postings_path, rejects_path)
    finally:
        kept.delete()


def _keep(messages: DataFrame, path: str) -> None:
    """Write a batch's messages in row groups that several tasks can share."""
    writer = messages.write.mode("overwrite").option("compression", CODEC)
    writer.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)


def start_ingest(
    messages: DataFrame,
    postings_path: str,
    rejects_path: str,
    checkpoint: str,
    order: Sequence[str],
    embedder: Embedder | None = None,
    dim: int = DIM,
    tasks: int | None = None,
    on_error: str = "raise",
    trigger: dict | None = None,
    index_path: str | None = None,
    store: VectorStore | None = None,
    status_path: str | None = None,
) -> StreamingQuery:
    """Store every micro-batch of a message stream.

    With the default trigger the query stops once all input that was there at
    the start is stored. The observed metric ``messages`` counts what came in; a
    ``status.BatchListener`` on the same ``status_path`` writes it down per batch.
    """
    counted = messages.observe(
        "messages",
        F.count("*").alias("received"),
        F.count_if(F.coalesce(F.col("value"), F.lit("")) == "").alias("empty"),
    )

    def store_one(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, postings_path, rejects_path, batch_id, order, embedder, dim, tasks, on_error, index_path, store, status_path)

    writer = counted.writeStream.foreachBatch(store_one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, REJECT)


def batch_status(postings: DataFrame, rejects: DataFrame) -> DataFrame:
    """Saved and rejected rows per batch."""
    saved = postings.groupBy("batch_id").agg(F.count("*").alias("saved"))
    failed = rejects.groupBy("batch_id").agg(F.count("*").alias("rejected"))
    both = saved.join(failed, "batch_id", "full")
    return both.fillna(0, ["saved", "rejected"])
