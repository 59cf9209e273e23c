"""Raw posting messages: topics, JSON decoding, rejects, publishing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.functions.encode import url_key
from pairwell.operators.json import field, kind, with_json
from pairwell.schemas import MESSAGE_DEFAULTS, MESSAGE_FIELDS
from pairwell.sources.batches import HASH_BYTES, SENT_BYTES

#: Columns by which the messages of a topic follow one another; offsets count within a partition.
TOPIC_ORDER = ("timestamp", "partition", "offset")


def read_topic(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", per_batch: int | None = None
) -> DataFrame:
    """Values of a Kafka topic as text, with their position for "last one wins".

    Offsets count within a partition: order messages by ``TOPIC_ORDER``. Needs the Kafka
    connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().select(F.col("value").cast("string").alias("value"), *TOPIC_ORDER)


def encode_messages(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as JSON messages with a null key."""
    body = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.lit(None).cast("string").alias("key"), body.alias("value"))


def publish(df: DataFrame, format: str, options: Mapping[str, str], columns: list[str] | None = None) -> None:
    """Append rows as JSON messages to any sink that takes a key and a value."""
    encode_messages(df, columns).write.format(format).options(**options).mode("append").save()


def write_topic(df: DataFrame, servers: str, topic: str, columns: list[str] | None = None) -> None:
    """Publish rows to a Kafka topic. Needs the Kafka connector on the class path."""
    publish(df, "kafka", {"kafka.bootstrap.servers": servers, "topic": topic}, columns)


def decode_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Add the message fields and ``reason``; a row with a reason is a reject.

    Empty messages are dropped. A field takes its default only when its key is
    absent: null stays null and the empty string stays empty. The years field
    keeps a JSON number in ``min_experience_number``, so that "2-3" (text) and
    -2 (number) are told apart.
    """
    present = df.filter(F.col(value) != "")
    parsed = with_json(present, value, "parsed")
    whole = F.col("parsed")
    is_object = kind(whole).startswith("OBJECT")
    reason = F.when(whole.isNull(), "not JSON").when(~is_object, "not an object")
    fields = [_text_field(name).alias(name) for name in MESSAGE_FIELDS]
    is_number = ~kind(whole, "min_experience_years").isin("STRING", "VOID")
    number = F.when(is_number, field(whole, "min_experience_years", "double"))
    return parsed.select(
        *df.columns, *fields, number.alias("min_experience_number"), reason.alias("reason")
    )


def _text_field(name: str) -> Column:
    parsed = F.col("parsed")
    text = field(parsed, name, "string")
    if name not in ("title", "job_requirements", "link"):
        text = F.when(kind(parsed, name) == "STRING", text)
    absent = field(parsed, name, "variant").isNull()
    return F.when(absent, F.lit(MESSAGE_DEFAULTS[name])).otherwise(text)


def valid_messages(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNull()).drop("reason")


def rejected_messages(decoded: DataFrame, *keep: str) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull()).select(*(keep or ("value",)), "reason")


def posting_id(link: Column, value: Column) -> Column:
    """Same id for the same posting, however often it is sent.

    The link without its fragment tells postings apart; the query string belongs to it.
    A message whose link names no page is its own posting.
    """
    page = F.regexp_extract(link, r"\A[^#]*", 0)
    return F.sha2(F.when(url_key(link) != "", page).otherwise(value), 256)


def last_per_posting(messages: DataFrame, order: Sequence[str]) -> DataFrame:
    """One message per posting id: the last one by the columns ``order``.

    Ids are counted first, by their hashes. Messages of an id that comes once stay where they are, while
    the hashes of the others fit ``SENT_BYTES``.
    """
    ids = messages.withColumn("posting_id", posting_id(F.col("link"), F.col("value")))
    # Two ids of one hash are ranked apart, as any others.
    coded = ids.withColumn("id_hash", F.xxhash64("posting_id"))
    repeated = coded.groupBy("id_hash").count().filter("count > 1").select("id_hash")
    count = repeated.count()
    if not count:
        return ids
    if count * HASH_BYTES > SENT_BYTES:
        return _last(ids, order)
    sent = F.broadcast(repeated)
    once, more = (coded.join(sent, "id_hash", how).drop("id_hash") for how in ("left_anti", "left_semi"))
    return once.unionByName(_last(more, order))


def _last(ids: DataFrame, order: Sequence[str]) -> DataFrame:
    by = Window.partitionBy("posting_id").orderBy(*[F.col(c).desc() for c in order], F.col("value").asc())
    return ids.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == 1).drop("rank")
