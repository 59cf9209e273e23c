"""Incremental compaction of batches into buckets, with manifests that readers pin.

Current postings lie in buckets by the hash of their id, ``TARGET_BYTES`` each or so. A
compaction takes the batches since the last one, rewrites only the buckets that their ids fall
into, in a folder of its own version, and then writes the manifest of that version: which folder
holds each bucket, and the last batch in it. A manifest counts once Spark has committed it, so a
compaction that ends before leaves readers where they were, and the next one writes its folder again.

Nothing is ever changed in place. Readers go on with the files of the manifest that they
started with, until ``remove`` deletes what none of the manifests to be kept needs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.schemas import POSTING
from pairwell.session import free_shuffles
from pairwell.sources.batches import BATCH, CODEC, SENT_BYTES, read_batches

TARGET_BYTES = 256 << 20
#: Buckets are made smaller when they hold this many times the target on average.
OVERSIZE = 4
#: Files of a bucket from which a compaction makes one of them.
FILES = 8

MANIFEST = "bucket int, data_version bigint, through bigint, buckets int"


@dataclass(frozen=True)
class Manifest:
    """Which version's folder holds each bucket, the last batch in the table, and the number of buckets."""

    version: int
    through: int
    buckets: int
    folders: dict[int, int]


class Folder:
    """A folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at)] if self.exists() else []

    def bytes(self) -> int:
        return self._fs.getContentSummary(self._at).getLength() if self.exists() else 0

    def text(self) -> str:
        """Content of a small text file."""
        stream = self._fs.open(self._at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, to: str) -> None:
        self._fs.rename(self._at, self._jvm.org.apache.hadoop.fs.Path(to))

    def delete(self) -> None:
        self._fs.delete(self._at, True)


def numbers(names: Iterable[str], prefix: str) -> list[int]:
    return sorted(int(name.removeprefix(prefix)) for name in names if name.startswith(prefix) and name.removeprefix(prefix).isdigit())


def manifests(spark: SparkSession, compacted: str) -> list[Manifest]:
    """Committed manifests, oldest first."""
    root = f"{compacted}/manifests"
    found = []
    for version in numbers(Folder(spark, root).names(), "version="):
        if Folder(spark, f"{root}/version={version}/_SUCCESS").exists():
            rows = spark.read.schema(MANIFEST).parquet(f"{root}/version={version}").collect()
            found.append(Manifest(version, rows[0]["through"], rows[0]["buckets"], {r["bucket"]: r["data_version"] for r in rows if r["bucket"] is not None}))
    return found


def write_manifest(spark: SparkSession, compacted: str, manifest: Manifest) -> None:
    rows = [(bucket, version, manifest.through, manifest.buckets) for bucket, version in sorted(manifest.folders.items())]
    # A table without rows still has a last batch.
    rows = rows or [(None, None, manifest.through, manifest.buckets)]
    frame = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    frame.write.mode("overwrite").parquet(f"{compacted}/manifests/version={manifest.version}")


def read_buckets(spark: SparkSession, compacted: str, manifest: Manifest, only: Iterable[int] | None = None) -> DataFrame:
    """Rows of the manifest's buckets, or of some of them."""
    wanted = manifest.folders.keys() if only is None else manifest.folders.keys() & set(only)
    schema = T.StructType([*POSTING.fields, BATCH])
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{compacted}/data/version={manifest.folders[b]}/bucket={b}" for b in sorted(wanted)])


def read_compacted(spark: SparkSession, compacted: str) -> tuple[DataFrame, int]:
    """Rows of the newest manifest and the last batch in them."""
    known = manifests(spark, compacted)
    if not known:
        raise ValueError(f"no compacted postings in {compacted}")
    return read_buckets(spark, compacted, known[-1]), known[-1].through


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("posting_id"), F.lit(buckets)).cast("int")


def files(spark: SparkSession, path: str) -> int:
    return sum(name.startswith("part-") for name in Folder(spark, path).names())


def not_sent_again(old: DataFrame, new: DataFrame) -> DataFrame | None:
    """Rows of ``old`` whose id ``new`` does not have, where they lie; None if the ids can't tell that in a small space.

    The 64-bit hashes of the new ids are sent to the tasks. That is exact, as no other id has one of them.
    """
    code = F.xxhash64("posting_id")
    ids = [rows.filter("posting_id IS NOT NULL").select("posting_id", code.alias("code"), F.lit(sent).alias("sent")) for rows, sent in ((old, False), (new, True))]
    asked = ids[1].select("code").distinct()
    if asked.count() * 8 > SENT_BYTES:
        return None
    alike = ids[0].unionByName(ids[1]).groupBy("code").agg(F.max("sent").alias("sent"), F.min("posting_id").alias("a"), F.max("posting_id").alias("b"))
    if not alike.filter("sent AND a <> b").isEmpty():
        return None
    codes = old.sparkSession.sparkContext.broadcast(np.sort(asked.toArrow().column("code").to_numpy()))

    @F.arrow_udf("boolean")
    def among(own: pa.Array) -> pa.Array:
        found = np.zeros(len(own), bool)
        if len(codes.value):
            code = own.to_numpy(zero_copy_only=False)
            place = np.searchsorted(codes.value, code)
            found = codes.value[np.minimum(place, len(codes.value) - 1)] == code
        return pa.array(found)

    return old.filter(F.col("posting_id").isNull() | ~among(code))


def compact_postings(spark: SparkSession, path: str, compacted: str, target_bytes: int = TARGET_BYTES) -> int:
    """Take the batches in ``path`` since the last compaction into the table; returns the last batch in it.

    Rows of buckets that no new posting falls into are neither read nor written. New rows
    move once, to their bucket, and the outdated ones are left out there. Old rows stay where they are read, but where the
    number of buckets changes or a bucket has ``FILES`` files. Without new batches nothing is written.
    """
    known = manifests(spark, compacted)
    last = known[-1] if known else Manifest(-1, -1, 0, {})
    rows = read_batches(spark, path, POSTING).filter(F.col("batch_id") > last.through)
    through = rows.agg(F.max("batch_id")).first()[0]
    if through is None:
        if not known:
            raise ValueError(f"no batches in {path}")
        return last.through
    new = rows.filter(F.col("batch_id") <= through)
    batches = [f"{path}/batch_id={b}" for b in numbers(Folder(spark, path).names(), "batch_id=") if last.through < b <= through]
    size = sum(Folder(spark, b).bytes() for b in batches)
    size += sum(Folder(spark, f"{compacted}/data/version={v}/bucket={b}").bytes() for b, v in last.folders.items())
    fitting = max(1, -(-size // target_bytes))
    version = last.version + 1
    kept_folders: dict[int, int] = {}
    in_place = None
    if fitting > OVERSIZE * last.buckets or not known:
        buckets, moving = fitting, read_buckets(spark, compacted, last)
    else:
        buckets = last.buckets
        touched = {r["bucket"] for r in new.select(bucket_of(buckets).alias("bucket")).distinct().collect()}
        kept_folders = {b: v for b, v in last.folders.items() if b not in touched}
        # Old rows lie in their buckets already. Where these have got many files, they are moved with the new ones.
        crowded = {b for b in touched & last.folders.keys() if files(spark, f"{compacted}/data/version={last.folders[b]}/bucket={b}") >= FILES}
        in_place = not_sent_again(read_buckets(spark, compacted, last, touched - crowded), new)
        moving = read_buckets(spark, compacted, last, touched if in_place is None else crowded)
    folder = f"{compacted}/data/version={version}"
    moved = moving.unionByName(new).withColumn("bucket", bucket_of(buckets)).repartition(buckets - len(kept_folders), "bucket")
    # All of these rows of an id lie in its bucket, so this window moves nothing. Rows without an id replace none.
    newest = F.rank().over(Window.partitionBy("bucket", "posting_id").orderBy(F.desc("batch_id")))
    current = moved.withColumn("newest", newest).filter((F.col("newest") == 1) | F.col("posting_id").isNull()).drop("newest")
    if in_place is not None:
        current = current.unionByName(in_place.withColumn("bucket", bucket_of(buckets)))
    (
        current.sortWithinPartitions("bucket", "posting_id")
        .write.mode("overwrite")
        .option("compression", CODEC)
        .partitionBy("bucket")
        .parquet(folder)
    )
    written = {b: version for b in numbers(Folder(spark, folder).names(), "bucket=")}
    write_manifest(spark, compacted, Manifest(version, through, buckets, kept_folders | written))
    return through


def removable(spark: SparkSession, path: str, compacted: str, keep: int = 1) -> list[str]:
    """Folders that none of the last ``keep`` manifests needs: batches, buckets and manifests.

    Afterwards the table is read with ``compacted`` only.
    """
    known = manifests(spark, compacted)
    kept_manifests = known[-max(keep, 1) :]
    if not kept_manifests:
        return []
    needed = {(v, b) for m in kept_manifests for b, v in m.folders.items()}
    through, newest = kept_manifests[0].through, kept_manifests[-1].version
    out = [f"{path}/batch_id={b}" for b in numbers(Folder(spark, path).names(), "batch_id=") if b <= through]
    for version in numbers(Folder(spark, f"{compacted}/data").names(), "version="):
        folder = f"{compacted}/data/version={version}"
        buckets = numbers(Folder(spark, folder).names(), "bucket=")
        # A version after the newest manifest may be in the making.
        if version <= newest:
            old = [b for b in buckets if (version, b) not in needed]
            out += [folder] if len(old) == len(buckets) else [f"{folder}/bucket={b}" for b in old]
    stay = {m.version for m in kept_manifests}
    versions = numbers(Folder(spark, f"{compacted}/manifests").names(), "version=")
    return out + [f"{compacted}/manifests/version={v}" for v in versions if v <= newest and v not in stay]


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders that ``removable`` has named, manifests last, and shuffle files of the compactions."""
    for folder in sorted(folders, key=lambda f: "/manifests/" in f):
        Folder(spark, folder).delete()
    free_shuffles(spark)
