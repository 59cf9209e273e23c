"""Line deduplication over hashed lines, in DataFrame and SQL functions only.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Of
a key, only two 64-bit hashes leave the text. The rows (key, document, position) are range
partitioned by key and sorted by document and position within a partition, so that the first
document of a key streams by before all others; every later line is dropped. Texts are not
moved for that: the result is a keep bitmap per document, compressed to its
runs, which ``with_kept_lines`` applies to the texts.

A key may hold a large share of all lines. Rows are counted in ``BUCKETS`` hash buckets first;
the rows of an overfull bucket are salted by document, cut to the first document of each salt,
and only these go on, so no range holds more of a key than one row per salt and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import kept
from pairwell.llm.quality import CAPITALS, SPACE_CHARS, bound

#: Code points of a key that can be dropped.
LEAST_CHARS = 10
#: Hash buckets in which lines are counted. One is overfull beyond this multiple of the mean, and these rows.
BUCKETS, OVERFULL, OVERFULL_ROWS = 1 << 16, 4, 512


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case; other capitals stay."""
    bare = F.btrim(line, F.lit(SPACE_CHARS))
    # Only letters of ASCII lines are all of A-Z; ``lower`` is several times faster than ``translate``.
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, CAPITALS, CAPITALS.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text_key, line, h1, h2) of lines whose key is long enough; ``line`` counts from 0."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(
        F.col(doc_id).alias("doc"), F.xxhash64(whole).alias("text_key"), F.posexplode(split_lines(F.col(text))).alias("line", "words")
    )
    keyed = lines.select("doc", "text_key", "line", line_key(F.col("words")).alias("key")).filter(F.length("key") >= LEAST_CHARS)
    return keyed.select("doc", "text_key", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def streamed_firsts(rows: DataFrame, *key: str) -> DataFrame:
    """The rows with ``first``: the smallest document of their key, nulls last.

    Range partitioning by the key also serves the window, so rows are shuffled once.
    """
    order = [F.asc_nulls_last("doc"), F.asc("line")]
    upto_here = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.repartitionByRange(*key).withColumn("first", F.first("doc").over(upto_here))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc, text_key, line) of the lines that an earlier document holds already."""
    bucket = F.col("h1").bitwiseAND(F.lit(BUCKETS - 1))
    counts = kept(lines.groupBy(bucket.alias("bucket")).count(), "line-buckets")
    total = counts.agg(F.sum("count")).first()[0] or 0
    room = OVERFULL * total // BUCKETS + OVERFULL_ROWS
    # At most BUCKETS rows, however many lines there are.
    overfull = counts.filter(F.col("count") > room).select("bucket", F.ceil(F.col("count") / room).alias("salts"))
    later = ~F.col("doc").eqNullSafe(F.col("first"))
    if overfull.isEmpty():
        return streamed_firsts(lines, "h1", "h2").filter(later).select("doc", "text_key", "line")
    marked = lines.withColumn("bucket", bucket).join(F.broadcast(overfull), "bucket", "left")
    salted = marked.filter("salts IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")))
    thinned = kept(streamed_firsts(salted, "h1", "h2", "salt").drop("salts", "salt", "bucket"), "thinned-lines")
    others = marked.filter("salts IS NULL").drop("salts", "bucket")
    rest = streamed_firsts(others.unionByName(thinned.filter(~later).drop("first")), "h1", "h2")
    return thinned.filter(later).unionByName(rest.filter(later)).select("doc", "text_key", "line")


def flips(dropped: Column) -> Column:
    """Where the keep bitmap flips, from the sorted numbers of dropped lines: begin and end of each dropped run."""
    begins = F.filter(dropped, lambda x, i: F.coalesce(F.get(dropped, i - 1) != x - 1, F.lit(True)))
    ends = F.filter(dropped, lambda x, i: F.coalesce(F.get(dropped, i + 1) != x + 1, F.lit(True)))
    return F.flatten(F.zip_with(begins, ends, lambda a, b: F.array(a, b + 1)))


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, n_lines, n_dropped, keep) of the documents that lose lines; all others keep every line.

    ``keep`` is the bitmap, compressed to its runs: the line numbers (from 0) at which it flips, in
    turn from kept to dropped and back. ``text_key`` is the hash of the text, which tells rows of
    one id apart.

    - A key of at least ``LEAST_CHARS`` code points that several documents hold stays in the
      smallest id only, there as often as it occurs. Lines with shorter keys stay everywhere.
    - A null text is empty: one empty line. Long texts are split whole.
    - Rows of one id are one document. All rows with a null id are one document, after all others.
      Equal rows have one bitmap. An empty table gives an empty table; other columns are left out.
    - Keys are equal if both of their 64-bit hashes are.
    """
    narrow = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    lines = kept(hashed_lines(narrow, "doc", "text"), "line-hashes")
    losing = dropped_lines(lines).groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    sized = narrow.select(
        "doc", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.size(split_lines(F.col("text"))).alias("n_lines")
    ).distinct()
    same = losing.doc.eqNullSafe(sized.doc) & (losing.text_key == sized.text_key)
    joined = losing.join(sized, same).select(losing.doc, losing.text_key, "n_lines", "dropped")
    return joined.select(
        "doc", "text_key", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        bound(F.col("dropped"), flips).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined by a newline."""

    def kept_runs(lines: Column) -> Column:
        def run(i: Column) -> Column:
            begin = F.coalesce(F.get(keep, 2 * i - 1), F.lit(0))
            end = F.coalesce(F.get(keep, 2 * i), F.size(lines))
            return F.slice(lines, begin + 1, end - begin)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(keep) / 2).cast("int")), run)), "\n")

    return bound(split_lines(text), kept_runs)


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text", name: str = "lines") -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of n_lines, n_dropped and kept (the text that is left).

    Bitmaps are those of ``keep_bitmaps`` for these documents. A document whose lines all go has an
    empty text; one without a bitmap keeps its text (null is empty). A column called ``name`` is replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    of_doc = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("text_key"))
    whole = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    left = F.struct(
        F.size(split_lines(whole)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), whole).otherwise(kept_text(whole, F.col("keep"))).alias("kept"),
    )
    joined = rows.join(bitmaps.select("doc", "text_key", "n_dropped", "keep"), of_doc, "left").select("row", left.alias("left"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != name], F.col("left").alias(name))
