"""Words, folds and kept tables that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.session import shared_dir

#: A word: a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id's text modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def kept(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """The table written to the shared folder and read again: lost executors do not repeat its work.

    ``codec`` is Spark's unless given; "zstd" takes more memory of a task and less disk.
    """
    path = shared_dir(df.sparkSession, purpose)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``docs`` under the names given here, and all others in one struct ``others``.

    What an operator adds to such a table can't clash with the names of the documents' own columns.
    """
    used = set(columns.values())
    others = [F.col(f"`{c}`").alias(f"own {c}") for c in docs.columns if c not in used]
    chosen = [F.col(f"`{c}`").alias(name) for name, c in columns.items()]
    return docs.select(*chosen, F.struct(F.lit(True).alias("packed"), *others).alias("others"))


def unpacked(docs: DataFrame, without: tuple[str, ...] = (), **columns: str) -> list[Column]:
    """The columns of ``docs`` as they are called there, from a table that ``packed`` made of it."""
    name_of = {c: name for name, c in columns.items()}
    own = lambda c: F.col(name_of[c]) if c in name_of else F.col("others").getField(f"own {c}")
    return [own(c).alias(c) for c in docs.columns if c not in without]


#: Rows of a table of a few narrow columns that one task may handle.
SMALL = 200_000


def kept_small(df: DataFrame, purpose: str) -> DataFrame:
    """As ``kept``, for narrow tables: one of up to ``SMALL`` rows comes as one partition.

    What follows on one partition needs no shuffle; a larger table is shuffled as always.
    """
    table = kept(df, purpose)
    return table.coalesce(1) if table.limit(SMALL + 1).count() <= SMALL else table
