"""Index columns beside the postings table, written per batch.

Next to every batch of postings lie the words of its titles, their counts, and the band rows of
its sketches. They are written once, so that a search neither splits a stored title
into words again nor counts the corpus. A batch that is written again replaces its part.

Postings that a later batch has replaced are left out at reading. Their words are counted from
the stored lists and taken off the sums of the batches.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.text import tokens
from pairwell.operators.block_join import Kernel, Limits, Matches, Search, best_of_each, fixed_matrix, flat_ids, id_bytes, measured, reaching, rounded
from pairwell.operators.bm25 import bm25_search, merged_counts, term_counts
from pairwell.operators.ranking import as_channel
from pairwell.operators.sketch import MAX_HASH, NUM_PERM, THRESHOLD, band_table
from pairwell.sources.batches import latest, outdated, read_batches, rows_of, write_batch

ID = T.StructField("posting_id", T.StringType())
WORDS = T.StructType([ID, T.StructField("tokens", T.ArrayType(T.StringType()))])
COUNTS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("docs", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("most", T.IntegerType()),
        T.StructField("shortest", T.IntegerType()),
    ]
)
BANDS = T.StructType([ID, T.StructField("band", T.IntegerType()), T.StructField("bucket", T.StringType())])

#: Band rows of a bucket from which its rows are dealt out over several tasks where both sides are large.
HOT_ROWS = 10_000


def write_index(postings: DataFrame, path: str, batch_id: int, threshold: float = THRESHOLD, num_perm: int = NUM_PERM) -> None:
    """Index one batch of postings: folders ``words``, ``counts`` and ``bands``, each by batch."""
    spark = postings.sparkSession
    write_batch(postings.select("posting_id", tokens(F.coalesce("title", F.lit(""))).alias("tokens")), f"{path}/words", batch_id)
    words = read_batches(spark, f"{path}/words", WORDS).filter(F.col("batch_id") == batch_id)
    write_batch(term_counts(words), f"{path}/counts", batch_id)
    sketched = postings.filter(filled(F.col("skills_signature")))
    write_batch(band_table(sketched, "posting_id", "skills_signature", threshold, num_perm), f"{path}/bands", batch_id)


def filled(signature: Column) -> Column:
    """Whether a sketch is not that of the empty set, which equals any other one."""
    return F.exists(signature, lambda x: x != MAX_HASH)


def indexed_words(spark: SparkSession, path: str) -> DataFrame:
    """``(posting_id, tokens)`` of the current postings."""
    return latest(read_batches(spark, f"{path}/words", WORDS)).drop("batch_id")


def replaced(spark: SparkSession, path: str) -> DataFrame:
    """``(posting_id, batch_id)`` of postings that a later batch has."""
    return outdated(read_batches(spark, f"{path}/words", WORDS))


def indexed_counts(spark: SparkSession, path: str) -> DataFrame:
    """Term statistics of the current postings, as ``bm25.term_counts`` gives them.

    ``most`` and ``shortest`` may stem from a replaced posting; they bound gains all the same.
    """
    sums = read_batches(spark, f"{path}/counts", COUNTS).drop("batch_id")
    old = rows_of(read_batches(spark, f"{path}/words", WORDS), replaced(spark, path))
    none = F.lit(None).cast("int")
    taken_off = term_counts(old).select("term", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"), none.alias("most"), none.alias("shortest"))
    return merged_counts(sums.unionByName(taken_off)).filter((F.col("docs") > 0) | (F.col("term") == ""))


def indexed_bands(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, band, bucket)`` of the current postings."""
    rows = read_batches(spark, f"{path}/bands", BANDS)
    current = rows_of(rows, replaced(spark, path), "left_anti")
    return current.select(F.col("posting_id").alias("doc_id"), "band", "bucket")


def indexed_bm25_topk(
    spark: SparkSession, path: str, profiles: DataFrame, k: int, limits: Limits = Limits(), digits: int | None = None, **options
) -> DataFrame:
    """As ``bm25_topk`` over the stored titles, from their stored words and statistics."""
    search = bm25_search(profiles, None, limits=limits, digits=digits, stats=indexed_counts(spark, path), **options)
    stored = indexed_words(spark, path).withColumnRenamed("posting_id", "doc_id")
    return as_channel(best_of_each([search], stored, k, limits), k)


# --- band index ---------------------------------------------------------------------------


class ListedKernel(Kernel):
    """Postings that come with the ids of the profiles that share a band, scored by equal positions."""

    def __init__(self, digits: int | None = None):
        self.digits = digits

    def prepare(self, profiles: pa.Table) -> SimpleNamespace:
        return SimpleNamespace(ids=flat_ids(profiles.column("cv_id")), sketches=fixed_matrix(profiles.column("signature")))

    def matches(self, state: SimpleNamespace, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        lists = postings.column("asking")
        profile = pc.index_in(lists.flatten(), value_set=state.ids)
        posting = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        known = profile.is_valid().to_numpy(zero_copy_only=False)
        profile, posting = profile.drop_null().to_numpy().astype(np.int64), posting[known]
        sketches = fixed_matrix(postings.column("signature"))
        score = np.empty(len(profile))
        for start in range(0, len(profile), 100_000):
            part = slice(start, start + 100_000)
            score[part] = (state.sketches[profile[part]] == sketches[posting[part]]).mean(axis=1)
        return reaching(profile, posting, rounded(score, self.digits), floor)


def banded_pairs(asked: DataFrame, stored: DataFrame, limits: Limits = Limits(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(cv_id, doc_id)``, each once, of rows (id, band, bucket) of both sides that share a bucket.

    Asked rows of a measured size are broadcast. Larger ones are shuffled by bucket; the stored
    rows of a bucket with more than ``hot_rows`` are dealt over several tasks, each with all of its asked rows.
    """
    size = measured(asked, id_bytes() + F.octet_length("bucket") + 8)
    if size <= limits.broadcast_bytes:
        return stored.join(F.broadcast(asked), ["band", "bucket"]).select("cv_id", "doc_id").distinct()
    wanted = stored.join(asked.select("band", "bucket").distinct(), ["band", "bucket"], "left_semi")
    counts = wanted.groupBy("band", "bucket").count().filter(F.col("count") > hot_rows)
    hot = counts.select("band", "bucket", F.ceil(F.col("count") / hot_rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = asked.join(hot, ["band", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    right = wanted.join(hot, ["band", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    return left.drop("salts").join(right.drop("salts"), ["band", "bucket", "salt"]).select("cv_id", "doc_id").distinct()


def indexed_lsh_topk(
    bands: DataFrame,
    profiles: DataFrame,
    postings: DataFrame,
    k: int,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    source: str = "lsh_minhash",
    limits: Limits = Limits(),
    digits: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As ``lsh_topk``, with candidates from stored band rows ``(doc_id, band, bucket)``.

    Both sides have an id and ``signature``; only postings with candidates are read further. Threshold
    and permutations must be those of the index.
    """
    known = profiles.select("cv_id", "signature").filter(filled(F.col("signature")))
    asked = band_table(known, "cv_id", "signature", threshold, num_perm)
    size = measured(known, F.size("signature") * 8 + 16 + id_bytes())
    # A posting of a hot bucket is asked for by very many profiles: their ids come in lists of a block each.
    parts = size // limits.block_bytes + 1
    pairs = banded_pairs(asked, bands, limits, hot_rows).withColumn("part", F.pmod(F.xxhash64("cv_id"), F.lit(parts)))
    listed = pairs.groupBy("doc_id", "part").agg(F.collect_list("cv_id").alias("asking"))
    candidates = postings.select("doc_id", "signature").join(listed, "doc_id").select("doc_id", "signature", "asking")
    search = Search(source, ListedKernel(digits), known, size, {"signature": "signature", "asking": "asking"})
    return as_channel(best_of_each([search], candidates, k, limits), k)
