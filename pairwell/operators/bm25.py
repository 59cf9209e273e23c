"""Keyword search by BM25, and the corpus statistics behind it."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.scores import BM25_B, BM25_BOOST, BM25_K1, bm25_idf
from pairwell.functions.text import tokens
from pairwell.operators.block_join import (
    NOISE_DIGITS,
    Kernel,
    Limits,
    Matches,
    Search,
    best_of_each,
    flat_ids,
    id_bytes,
    measured,
    reaching,
    rounded,
)
from pairwell.operators.ranking import as_channel
from pairwell.operators.terms import TermIndex, encode_terms, term_hits
from pairwell.session import shared_dir


class Bm25Kernel(Kernel):
    """Weighted term gains; profile rows are ``(cv_id, term, weight, peak)``.

    ``peak`` bounds what the term can add to any posting (MaxScore). Once a profile has ``k``
    postings, words whose peaks do not reach its floor even together find no postings of their
    own: they only add to those that the profile's other words have found.
    """

    def __init__(self, mean_length: float, k1: float, b: float, digits: int | None = None):
        self.mean_length, self.k1, self.b, self.digits = mean_length, k1, b, digits

    def prepare(self, profiles: pa.Table) -> SimpleNamespace:
        ids = flat_ids(profiles.column("cv_id")).dictionary_encode()
        owner, peak = ids.indices.to_numpy(), profiles.column("peak").to_numpy()
        order = np.lexsort((peak, owner))
        ahead = np.cumsum(peak[order])
        begins = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]][: len(order)])
        before = (ahead - peak[order])[begins]
        reach = np.empty(len(order))
        # Of each use: its peak and all smaller ones of the same profile.
        reach[order] = ahead - np.repeat(before, np.diff(np.r_[begins, len(order)]))
        index = TermIndex.from_rows(flat_ids(profiles.column("term")), owner, profiles.column("weight").to_numpy(), reach)
        return SimpleNamespace(ids=ids.dictionary, index=index)

    def encode(self, state: SimpleNamespace, postings: pa.RecordBatch) -> pa.RecordBatch:
        return encode_terms(state.index, postings)

    def matches(self, state: SimpleNamespace, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        lists = postings.column("tokens")
        length = lists.value_lengths().to_numpy(zero_copy_only=False)
        hits = term_hits(state.index, lists)
        norm = self.k1 * (1 - self.b + self.b * length[hits.posting] / self.mean_length)
        gain = hits.times * (self.k1 + 1) / (hits.times + norm)
        # Rounding may lift a score by half a unit.
        unit = 10.0 ** -(NOISE_DIGITS if self.digits is None else self.digits)
        essential = state.index.reach + unit >= floor[state.index.profile]
        cells, total = state.index.add_up(hits, gain, len(lists), essential)
        profile, posting = np.divmod(cells[total > 0], max(len(lists), 1))
        return reaching(profile, posting, rounded(total[total > 0], self.digits), floor)


def corpus_stats(postings: DataFrame, token_column: str = "tokens") -> DataFrame:
    """Per term: postings that contain it, and occurrences in all of them.

    One scan and one shuffle. Counting starts map-side, so a term found in
    every posting reaches the shuffle as one row per task.
    """
    every = F.transform(token_column, lambda t: F.struct(t.alias("term"), F.lit(0).alias("doc")))
    once = F.transform(
        F.array_distinct(token_column), lambda t: F.struct(t.alias("term"), F.lit(1).alias("doc"))
    )
    words = postings.select(F.inline(F.concat(every, once)))
    return words.groupBy("term").agg(
        F.sum("doc").alias("docs"), F.sum(1 - F.col("doc")).alias("occurrences")
    )


def corpus_totals(postings: DataFrame, token_column: str = "tokens") -> DataFrame:
    """One row: number of postings, tokens in all, mean length."""
    length = F.size(F.coalesce(F.col(token_column), F.array().cast("array<string>")))
    return postings.agg(
        F.count("*").alias("docs"),
        F.sum(length).alias("total_tokens"),
        F.avg(length).alias("mean_length"),
    )


# Stands for the whole corpus among the terms: no word is empty.
CORPUS = ""


def term_counts(postings: DataFrame, token_column: str = "tokens") -> DataFrame:
    """Mergeable statistics ``(term, docs, tokens, most, shortest)``, and of the corpus as term ``""``.

    ``docs`` and ``tokens`` (occurrences in them; of the corpus, all tokens) add up over batches. ``most``, the
    most occurrences in one posting, and ``shortest``, the length of the shortest posting with
    the term, bound the term's gain; they merge by maximum and minimum.
    """
    words = F.coalesce(F.col(token_column), F.array().cast("array<string>"))
    listed = postings.select(F.size(words).alias("length"), words.alias("words"))
    # Words of a row are counted by a sort: a filter per word would be quadratic in long texts.
    sorted_words = F.sort_array("words")
    starts = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("ordered", i) != F.get("ordered", i - 1)))
    ordered = listed.filter("length > 0").select("length", sorted_words.alias("ordered")).select("length", "ordered", starts.alias("starts"))
    each = F.transform(
        "starts",
        lambda start, n: F.struct(
            F.get("ordered", start).alias("term"), (F.coalesce(F.get("starts", n + 1), F.col("length")) - start).alias("times")
        ),
    )
    found = ordered.select("length", F.inline(each))
    counts = found.groupBy("term").agg(
        F.count("*").alias("docs"), F.sum("times").cast("long").alias("tokens"), F.max("times").alias("most"), F.min("length").alias("shortest")
    )
    whole = listed.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("tokens"))
    none = F.lit(None).cast("int")
    return counts.unionByName(whole.select(F.lit(CORPUS).alias("term"), "docs", "tokens", none.alias("most"), none.alias("shortest")))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Statistics of several batches as one."""
    return counts.groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.max("most").alias("most"), F.min("shortest").alias("shortest")
    )


def asked_term_stats(postings: DataFrame, vocabulary: DataFrame, vocabulary_size: int, limits: Limits) -> DataFrame:
    """``(term, docs, tokens)`` of asked terms, and of the corpus as term ``""``.

    One pass over the postings serves both. While the vocabulary fits the bound
    it is broadcast, so that only counts of asked terms reach the shuffle.
    """
    whole = F.struct(F.lit(CORPUS).alias("term"), F.coalesce(F.size("tokens"), F.lit(0)).alias("tokens"))
    each = F.transform(
        F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))),
        lambda t: F.struct(t.alias("term"), F.lit(0).alias("tokens")),
    )
    words = postings.select(F.inline(F.concat(F.array(whole), each)))
    if vocabulary_size <= limits.broadcast_bytes:
        corpus = vocabulary.sparkSession.range(1).select(F.lit(CORPUS).alias("term"))
        words = words.join(F.broadcast(vocabulary.union(corpus)), "term", "left_semi")
    return words.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def tokenised(postings: DataFrame, posting_text: str) -> DataFrame:
    """``(doc_id, tokens)``, written once: whatever reads them, each text is split into words once."""
    stored = postings.select("doc_id", tokens(F.col(posting_text)).alias("tokens"))
    path = shared_dir(postings.sparkSession, "tokens")
    stored.write.parquet(path)
    return stored.sparkSession.read.schema(stored.schema).parquet(path)


def bm25_search(
    profiles: DataFrame,
    postings: DataFrame | None,
    profile_text: str = "title",
    posting_tokens: str = "tokens",
    boost: float = BM25_BOOST,
    k1: float = BM25_K1,
    b: float = BM25_B,
    dedup_terms: bool = False,
    source: str = "bm25",
    limits: Limits = Limits(),
    digits: int | None = None,
    stats: DataFrame | None = None,
) -> Search:
    """Search for the postings whose words match any word of every profile's text.

    ``stats`` holds stored statistics (``term_counts``); without them the tokens of ``postings`` are
    read for statistics first.
    """
    words = profiles.select("cv_id", F.explode(tokens(F.col(profile_text))).alias("term"))
    asked = words.groupBy("cv_id", "term").agg(F.count("*").alias("times"))
    # Also bounds the vocabulary and the weighted terms, which have no more rows.
    size = measured(asked, F.octet_length("term") + 40 + id_bytes())
    if stats is None:
        listed = postings.select(F.col(posting_tokens).alias("tokens"))
        unknown = F.lit(None).cast("int")
        stats = asked_term_stats(listed, asked.select("term").distinct(), size, limits).withColumns({"most": unknown, "shortest": unknown})
        path = shared_dir(stats.sparkSession, "term-stats")
        stats.write.parquet(path)
        stats = stats.sparkSession.read.schema(stats.schema).parquet(path)
    corpus = stats.filter(F.col("term") == CORPUS).first()
    docs, total = (corpus["docs"], corpus["tokens"]) if corpus else (0, 0)
    mean = total / docs if total else 1.0
    times = F.lit(1) if dedup_terms else F.col("times")
    weight = boost * bm25_idf(F.col("docs"), docs) * times
    most, shortest = F.coalesce("most", F.lit(float("inf"))), F.coalesce("shortest", F.lit(0))
    highest = (k1 + 1) / (1 + k1 * (1 - b + b * shortest / mean) / most)
    weighted = asked.join(stats.filter(F.col("term") != CORPUS), "term").withColumn("weight", weight)
    rows = weighted.select("cv_id", "term", "weight", (F.col("weight") * highest).alias("peak"))
    return Search(source, Bm25Kernel(mean, k1, b, digits), rows, size, {"tokens": posting_tokens})


def bm25_topk(
    profiles: DataFrame,
    postings: DataFrame,
    k: int,
    profile_text: str = "title",
    posting_text: str = "title",
    boost: float = BM25_BOOST,
    k1: float = BM25_K1,
    b: float = BM25_B,
    dedup_terms: bool = False,
    source: str = "bm25",
    limits: Limits = Limits(),
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` postings whose text matches any word of every profile's text best.

    ``digits`` rounds scores before they rank.
    """
    stored = tokenised(postings, posting_text)
    search = bm25_search(profiles, stored, profile_text, "tokens", boost, k1, b, dedup_terms, source, limits, digits)
    return as_channel(best_of_each([search], stored, k, limits), k)
