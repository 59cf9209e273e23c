"""Mix sources to target weights with Pareto order sampling.

Every document of a source is expected ``target / source size`` times in the mix.
The whole part of that number is certain copies. The fraction is an inclusion
probability ``p``, and documents are ranked by

    (u / (1 - u)) / (p / (1 - p)),    u = the document's fixed uniform number,

the order of Pareto sampling. The sample is of fixed size in words: it ends at the
rank where the running sum of sizes lies nearest to what the certain copies leave
of the target, so a source misses its target by half of one document at most.

The running sum is never taken over a whole source in one task, nor over all sources. Ranks fall into
``BINS`` ranges whose sizes are summed map-side; only the documents of the one range
per source in which the sum crosses the rest are ordered exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import kept, packed, unpacked, word_count

BINS = 1 << 14
MAX_COPIES = 2
#: Plans of up to this many sources are broadcast (about 60 bytes each); more are joined.
BROADCAST_SOURCES = 100_000


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1, fixed by id, text and seed: 52 bits of MD5, never 0 or 1."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), content).cast("binary"))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return (number + 0.5) / float(1 << 52)


def in_order(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with the number of each row in the order (``turn``, from 1) and, per entry, the sum of a column over the rows before.

    Rows are range-partitioned and numbered within their range; only a row per range is summed in one task.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = kept(df.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range").orderBy(*keys)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    wholes = ranged.groupBy("range").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"whole_{name}") for name, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = wholes.select(
        "range",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"),
        *[F.coalesce(F.sum(f"whole_{name}").over(earlier), none).alias(f"offset_{name}") for name in sums],
    )
    numbered = ranged.withColumns(
        {"turn": F.row_number().over(within)} | {name: F.coalesce(F.sum(c).over(ahead), none) for name, c in sums.items()}
    )
    # A row per range: no more than shuffle partitions.
    joined = numbered.join(F.broadcast(offsets), "range")
    whole = {"turn": F.col("turn") + F.col("offset")} | {name: F.col(name) + F.col(f"offset_{name}") for name in sums}
    return joined.withColumns(whole).drop("range", "offset", *[f"offset_{name}" for name in sums])


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Target of every source; ``sizes`` holds ``mix_source`` and ``source_size``, a row per source.

    Sources are ordered by code point, null last, and take the weights in turn.
    ``share * total`` is dealt by weight; a target stops at ``cap`` times its source's
    size and the excess goes to the others by weight. That is one level ``l`` for all:
    ``target = min(cap * size, l * weight)``. Ordered by ``cap * size / weight``, the
    sources that stop are a prefix, so ``l`` follows from running sums over sources.
    """
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    named = in_order(sizes.select("mix_source", "source_size"), ["mix_source"], {})
    named = named.withColumn("w", F.element_at(dealt, ((F.col("turn") - 1) % len(weights) + 1).cast("int"))).drop("turn")
    named = named.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    levels = kept(in_order(named, ["ratio", "mix_source"], {"before": "most", "w_before": "w"}), "mix-levels")
    whole = levels.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    total, w = share * (whole["words"] or 0), whole["w"] or 0.0
    levels = levels.withColumn("level", (F.lit(total) - F.col("before")) / (F.lit(w) - F.col("w_before")))
    # The first source that the level does not bring to its limit; those before it stop there.
    common = levels.agg(F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("turn")))).first()[0]
    level = F.lit(float("inf") if common is None else common)
    return levels.select("mix_source", "source_size", F.least(F.col("source_size") * float(cap), level * F.col("w")).alias("target"))


def plan(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: target, certain copies, and the last range and rank that are taken once more."""
    sizes = sized.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    source = targets(sizes, weights, share, cap).withColumn("expected", expected)
    source = source.withColumn("certain", F.floor("expected").cast("long"))
    source = kept(
        source.withColumn("odds", (F.col("expected") - F.col("certain")) / (1 - (F.col("expected") - F.col("certain"))))
        .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")),
        "mix-sources",
    )
    ranked = ranks(sized, source)
    bins = kept(
        ranked.groupBy("mix_source", "mix_bin").agg(F.sum("mix_size").alias("words")).withColumn(
            "upto", F.sum("words").over(Window.partitionBy("mix_source").orderBy("mix_bin"))
        ),
        "mix-bins",
    )
    edge = (
        join_sources(bins, source)
        .filter("upto > rest")
        .groupBy("mix_source", "rest")
        .agg(F.min(F.struct("mix_bin", "upto", "words")).alias("edge"))
        .select("mix_source", "rest", F.col("edge.mix_bin").alias("last_bin"), (F.col("edge.upto") - F.col("edge.words")).alias("before"))
    )
    edge = kept(edge, "mix-edges")
    inside = join_sources(ranked.select("mix_source", "mix_bin", "mix_rank", "mix_size"), edge).filter("mix_bin = last_bin")
    running = F.sum("words").over(Window.partitionBy("mix_source").orderBy("mix_rank")) + F.col("before")
    steps = (
        inside.groupBy("mix_source", "before", "rest", "mix_rank")
        .agg(F.sum("mix_size").alias("words"))
        .withColumn("upto", running)
    )
    # Of the last sum within the rest and the first beyond it, the nearer one.
    below = F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("upto", "mix_rank")))
    above = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("upto", "mix_rank")))
    ends = steps.groupBy("mix_source", "before", "rest").agg(below.alias("below"), above.alias("above"))
    low = F.coalesce(F.col("below.upto"), F.col("before"))
    nearer = F.col("above.upto") - F.col("rest") < F.col("rest") - low
    last_rank = F.when(nearer, F.col("above.mix_rank")).otherwise(F.coalesce(F.col("below.mix_rank"), F.lit(-1.0)))
    cut = ends.select(F.col("mix_source").alias("cut_source"), last_rank.alias("last_rank")).join(
        edge.select(F.col("mix_source").alias("edge_source"), "last_bin"),
        F.col("cut_source").eqNullSafe(F.col("edge_source")),
    )
    whole = source.join(cut, F.col("mix_source").eqNullSafe(F.col("cut_source")), "left")
    return kept(whole.select("mix_source", "source_size", "target", "certain", "odds", "last_bin", "last_rank"), "mix-plan")


def join_sources(df: DataFrame, source: DataFrame) -> DataFrame:
    """Rows with the columns of their source; broadcast only while the counted sources are few."""
    named = source.withColumnRenamed("mix_source", "mix_source_key")
    if source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    return df.join(named, F.col("mix_source").eqNullSafe(F.col("mix_source_key")), "left").drop("mix_source_key")


def ranks(sized: DataFrame, source: DataFrame) -> DataFrame:
    """Rank by random odds over inclusion odds, and its range."""
    u = F.col("mix_uniform")
    rank = F.when(F.col("odds") > 0, u / (1 - u) / F.col("odds"))
    joined = join_sources(sized, source.select("mix_source", "odds")).withColumn("mix_rank", rank)
    position = F.col("mix_rank") / (1 + F.col("mix_rank"))
    return joined.filter("odds > 0").withColumn("mix_bin", F.floor(position * BINS).cast("long"))


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    seed: int = 0,
) -> DataFrame:
    """All columns of ``docs`` and ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies``, ``mix_taken``.

    - Size is the number of words; a null text has 0. A document of no words is expected
      as often as the others of its source but takes no words.
    - A null source is a source of its own, the last in order. A null id is an id like any other.
    - The uniform number is fixed by id and text: rows with both equal are taken together, or
      none of them.
    - No document has more than ``MAX_COPIES`` copies. An empty table gives an empty table.
    - Columns of ``docs`` with the names of the result are replaced. Reruns give the same rows.
    """
    own = {"mix_id": doc_id, "mix_text": text, "mix_source": source}
    columns = packed(docs, **own)
    keyed = columns.withColumns(
        {"mix_size": word_count(F.col("mix_text")), "mix_uniform": uniform(F.col("mix_id"), F.col("mix_text"), seed)}
    )
    sized = kept(keyed.select("mix_source", "mix_size", "mix_uniform"), "mix-sizes")
    chosen = plan(sized, weights, share, float(MAX_COPIES))
    planned = join_sources(keyed, chosen)
    u = F.col("mix_uniform")
    rank = u / (1 - u) / F.col("odds")
    bin_of = F.floor(rank / (1 + rank) * BINS).cast("long")
    once_more = (F.col("odds") > 0) & F.when(
        F.col("last_bin").isNull(), F.lit(True)
    ).otherwise((bin_of < F.col("last_bin")) | ((bin_of == F.col("last_bin")) & (rank <= F.col("last_rank"))))
    copies = F.col("certain") + F.coalesce(once_more, F.lit(False)).cast("long")
    results = {
        "mix_size": F.col("mix_size"),
        "mix_source_size": F.col("source_size"),
        "mix_target": F.col("target"),
        "mix_copies": copies,
        "mix_taken": copies * F.col("mix_size"),
    }
    made = planned.select("*", F.struct(*[c.alias(name) for name, c in results.items()]).alias("mixed"))
    return made.select(*unpacked(docs, tuple(results), **own), "mixed.*")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it has copies, without the columns that ``mix`` adds."""
    added = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
    rows = mixed.select(F.struct(*[c for c in mixed.columns if c not in added]).alias("row"), "mix_copies")
    times = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return rows.select("row", F.explode(times)).select("row.*")
