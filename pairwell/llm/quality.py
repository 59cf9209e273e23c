"""Quality rules: text statistics and a learned decision list, in Spark expressions only.

The list is learned by sequential covering from labelled statistics. A rule grows on two
thirds of the labelled documents by the threshold with the best information gain, loses its
last conditions where the other third shows that they don't help, and is accepted if it is
precise there; what a rule covers, accepted or not, is set aside for the next one, until
too few bad documents are left for any rule to pass. Every count is an aggregation over all
labelled documents that are left; the driver sees histograms of ``BINS`` thresholds per
statistic. The result is a list of ``when`` conditions.

The search is bounded by ``BINS`` thresholds per statistic and class and ``CONDITIONS``
conditions a rule; the list, by the size of its expression alone (``EXPRESSION`` conditions).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import WORD, fold, kept, packed, unpacked

#: Fixed values of the base rule.
LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Thresholds per statistic and class, conditions of a rule, conditions of all rules.
BINS = 32
CONDITIONS = 4
EXPRESSION = 400
#: What a rule must show on the third that it was not grown on.
PRECISION = 0.9
LEAST_COVERED = 2

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "marks", "line_words")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text.

    Windows are compared by hash. Only a text with equal windows is sorted: its windows by
    hash and place, then the places that have an equal neighbour; each adds the words that
    the place before it has not covered.
    """

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows: Column) -> Column:
            def twin(row: Column, k: Column) -> Column:
                before = (k > 0) & (F.get(rows, k - 1)["h"] == row["h"])
                after = F.get(rows, k + 1)["h"] == row["h"]
                return before | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, twin), lambda row: row["i"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda a, i: F.struct(
            i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total")
        )
        sums = F.aggregate(bound(placed, places), start, step, lambda a: a["total"])
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), sums).otherwise(F.lit(0).cast("long"))

    def windows_of(hashes: Column) -> Column:
        last = F.size(hashes) - WINDOW + 1
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    long_enough = F.size(words) > WINDOW
    return F.when(long_enough, bound(hashes, lambda h: bound(windows_of(h), covered))).otherwise(F.lit(0).cast("long"))


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> Column:
    """Struct of the counts and the shares that the rules look at; null text counts as empty.

    Shares of an empty text are 0. Texts are read whole.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), F.size(F.array_distinct(x)).cast("long").alias("n_own"))

    def whole(word: Column, line: Column, chars: Column) -> Column:
        symbols, capitals = chars["all"] - chars["no_symbols"], chars["all"] - chars["no_capitals"]
        marks = chars["all"] - chars["no_marks"]
        dup_lines = line["n_lines"] - line["n_own"]
        return F.struct(
            word["n_words"].alias("n_words"),
            chars["words"].alias("word_chars"),
            symbols.alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            word["n_repeat_words"].alias("n_repeat_words"),
            word["n_words"].cast("double").alias("words"),
            share(chars["words"], word["n_words"]).alias("word_length"),
            share(symbols, chars["words"]).alias("symbols"),
            share(dup_lines, line["n_lines"]).alias("dup_lines"),
            share(word["n_repeat_words"], word["n_words"]).alias("repeats"),
            share(word["n_distinct"], word["n_words"]).alias("distinct"),
            share(capitals, chars["words"]).alias("capitals"),
            share(marks, chars["words"]).alias("marks"),
            share(word["n_words"], line["n_lines"]).alias("line_words"),
        )

    chars = F.struct(
        F.length(text).cast("long").alias("all"),
        without(text, SPACE_CHARS).cast("long").alias("words"),
        without(text, SYMBOLS).cast("long").alias("no_symbols"),
        without(text, CAPITALS).cast("long").alias("no_capitals"),
        without(text, "!?").cast("long").alias("no_marks"),
    )
    return bound(
        chars, lambda c: bound(bound(lines, of_lines), lambda x: bound(bound(words, of_words), lambda w: whole(w, x, c)))
    )


def with_statistics(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Documents with the struct of statistics; an explode of one keeps later filters from computing it again."""
    return docs.select("*", F.explode(F.array(statistics(F.col(text)))).alias(name))


def base_failed(stats: str) -> Column:
    words, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * words)


# --- learning -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """A statistic at or above a threshold, or below it."""

    feature: str
    above: bool
    threshold: float

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.feature}")
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def holds(rule: Rule, stats: str) -> Column:
    return reduce(and_, (c.column(stats) for c in rule))


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Ascending candidate thresholds per statistic: quantiles of bad and of good documents."""
    shares = [k / (BINS - 1) for k in range(BINS)]
    quantiles = [
        F.percentile_approx(F.when(F.col("bad") == bad, F.col(f"s.{name}")), shares).alias(f"{name}_{bad}")
        for name in FEATURES
        for bad in (0, 1)
    ]
    row = labelled.agg(*quantiles).first()
    return {name: sorted({*(row[f"{name}_0"] or []), *(row[f"{name}_1"] or [])}) for name in FEATURES}


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of a condition that leaves p bad and n good of p0 and n0."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def counted(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per statistic, bad and good documents in each of its bins."""
    found = (
        rows.select("bad", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        .collect()
    )
    table = {name: [(0, 0)] * (len(cuts[name]) + 1) for name in FEATURES}
    for r in found:
        table[FEATURES[r["feature"]]][r["bin"]] = (r["p"], r["n"])
    return table


def best_condition(table: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]]) -> Condition | None:
    best, most = None, 1e-9
    for name, bins in table.items():
        p0, n0 = sum(p for p, _ in bins), sum(n for _, n in bins)
        below_p = below_n = 0
        for (p, n), threshold in zip(bins, cuts[name]):
            below_p, below_n = below_p + p, below_n + n
            for above, (a, b) in ((True, (p0 - below_p, n0 - below_n)), (False, (below_p, below_n))):
                if a + b < p0 + n0 and (value := gain(a, b, p0, n0)) > most:
                    best, most = Condition(name, above, threshold), value
    return best


def grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        chosen = rows.filter(holds(rule, "s")) if rule else rows
        table = counted(chosen, cuts)
        first = next(iter(table.values()))
        if not sum(p for p, _ in first) or not sum(n for _, n in first):
            break
        condition = best_condition(table, cuts)
        if condition is None:
            break
        rule += (condition,)
    return rule


def prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that is worth most on other documents, and what it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        inside = holds(rule[:k], "s")
        sums += [F.sum(F.when(inside, F.col("bad"))).alias(f"p{k}"), F.sum(F.when(inside, 1 - F.col("bad"))).alias(f"n{k}")]
    row = rows.agg(*sums).first()
    worth = [((row[f"p{k}"] or 0), (row[f"n{k}"] or 0), k) for k in range(1, len(rule) + 1)]
    p, n, k = max(worth, key=lambda x: ((x[0] - x[1]) / max(x[0] + x[1], 1), x[0], -x[2]))
    return rule[:k], p, n


def learn(labelled: DataFrame) -> list[Rule]:
    """Ordered rules for bad documents from ``labelled(doc_id, s, bad)``; none if a class is missing.

    The third of documents whose id's CRC-32 is 0 modulo 3 prunes, the rest grows.
    """
    cuts = thresholds(labelled)
    if not all(cuts.values()):
        return []

    def bin_of(feature: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[feature])), lambda t: t <= F.col(f"s.{feature}")))

    bins = [bin_of(feature) for feature in FEATURES]
    prunes = F.coalesce(fold(F.col("doc_id"), 3), F.lit(1)) == 0
    rows = kept(labelled.select("s", "bad", F.array(*bins).alias("bins"), prunes.alias("prunes")), "quality-bins")
    rules: list[Rule] = []
    while sum(map(len, rules)) < EXPRESSION:
        left = rows.filter("bad = 1").agg(F.count_if("prunes").alias("prunes"), F.count_if(~F.col("prunes")).alias("grows")).first()
        if not left["grows"] or left["prunes"] < LEAST_COVERED:
            break
        grown = grow(rows.filter(~F.col("prunes")), cuts)
        if not grown:
            break
        rule, p, n = prune(rows.filter("prunes"), grown)
        if p >= LEAST_COVERED and p >= PRECISION * (p + n):
            rules.append(rule)
            grown = rule
        rows = rows.filter(~holds(grown, "s"))
    return rules


def verdict(rules: list[Rule], stats: str) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(holds(rules[k - 1], stats), F.lit(k)).otherwise(out)
    return out


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, s, bad) of documents with a quality label; ``stats`` holds doc_id and s."""
    marks = labels.filter("quality IS NOT NULL").select(
        F.col("doc_id").alias("label_id"), F.when(F.col("quality") > 0, 0).otherwise(1).cast("long").alias("bad")
    )
    return stats.join(marks, F.col("doc_id") == F.col("label_id")).select("doc_id", "s", "bad")


def learned_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> list[Rule]:
    """Rules from the labels of documents, learned on every labelled document.

    - Only documents with a label get statistics. A null label or id is no label.
    - A document with several labels counts once for each of them, also for equal ones; rows of one id each have its labels.
    - Without labels of both kinds, or in an empty table, there are no rules.
    """
    marked = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("label_id"))
    own = packed(docs, doc_id=doc_id, text=text).select("doc_id", "text")
    narrow = with_statistics(own.join(marked, F.col("doc_id") == F.col("label_id"), "left_semi"), "text", "s")
    return learn(kept(labelled_statistics(narrow.select("doc_id", "s"), labels), "quality-labelled"))


def good_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that pass the base rule and the rules learned from ``labels``, with all columns of theirs.

    Statistics are computed once and written with the documents: the rules are learned from the
    labelled ones, then all are judged. Nulls, ties and repeated rows are those of ``learned_rules`` and ``judged``.
    """
    own = {"doc_id": doc_id, "text": text}
    rows = kept(with_statistics(packed(docs, **own), "text", "s"), "quality-rows")
    rules = learn(kept(labelled_statistics(rows.select("doc_id", "s"), labels), "quality-labelled"))
    return rows.filter(~base_failed("s") & (verdict(rules, "s") == 0)).select(*unpacked(docs, **own))


def judged(docs: DataFrame, rules: list[Rule], *, text: str = "text", stats: str = "quality_stats") -> DataFrame:
    """All columns of ``docs``, the struct ``stats``, ``base_failed``, ``rule`` and ``kept``.

    - A null or empty text has no words and fails the base rule.
    - Rows are judged one by one: null ids, ties and repeated rows change nothing.
    - An empty table gives an empty table; without rules only the base rule rejects.
    - Columns of ``docs`` with the names of the result are replaced.
    """
    own = {"judged_text": text}
    rows = with_statistics(packed(docs, **own), "judged_text", "s")
    failed, rule = base_failed("s"), verdict(rules, "s")
    made = rows.select("*", failed.alias("failed"), rule.alias("rule_number"))
    return made.select(
        *unpacked(docs, (stats, "base_failed", "rule", "kept"), **own),
        F.col("s").alias(stats),
        F.col("failed").alias("base_failed"),
        F.col("rule_number").alias("rule"),
        (~F.col("failed") & (F.col("rule_number") == 0)).alias("kept"),
    )
