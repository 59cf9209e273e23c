"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.bpe import round_trip
from pairwell.llm.extract import extracted
from pairwell.llm.fingerprint import with_fingerprints
from pairwell.llm.language import learn as learn_languages
from pairwell.llm.language import predicted
from pairwell.llm.line_dedup import keep_bitmaps, with_kept_lines
from pairwell.llm.mixing import mix
from pairwell.llm.ngram_join import jaccard_components
from pairwell.llm.common import fold, kept
from pairwell.llm.phrases import collocations
from pairwell.llm.ppm import held_out, scored
from pairwell.llm.quality import COUNTS, base_failed, labelled_statistics, learn, verdict, with_statistics
from pairwell.llm.spelling import spelling_variants
from pairwell.llm.token_files import document_counts, token_counts, write_tokens
from pairwell.llm.warc import assemble, page_ids, read_records, write_captures
from pairwell.session import shared_dir

#: Fixed value: the id that ends a document in the vocabulary used here.
END_OF_DOCUMENT = 50256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def q_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


MIX_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sources),
ratios AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / w AS ratio FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(lim) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY ratio, encode(source) NULLS LAST) AS turn
  FROM ratios),
targets AS (
  SELECT source, source_size, least(lim, coalesce(arg_min(level, CASE WHEN level <= ratio THEN turn END) OVER () * w, 'inf'::DOUBLE)) AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected FROM targets),
odds AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS certain, (expected - floor(expected)) / (1 - (expected - floor(expected))) AS odds,
         target - floor(expected) * source_size AS rest
  FROM parts),
ranked AS (
  SELECT d.doc_id, d.size, o.*, CASE WHEN odds > 0 THEN u / (1 - u) / odds END AS rank
  FROM docs d JOIN odds o ON d.source IS NOT DISTINCT FROM o.source),
running AS (
  SELECT source, rank, rest, sum(sum(size)) OVER (PARTITION BY source ORDER BY rank) AS upto
  FROM ranked WHERE odds > 0 GROUP BY source, rank, rest),
ends AS (
  SELECT source, rest, max(CASE WHEN upto <= rest THEN upto END) AS low, max(CASE WHEN upto <= rest THEN rank END) AS low_rank,
         min(CASE WHEN upto > rest THEN upto END) AS high, min(CASE WHEN upto > rest THEN rank END) AS high_rank
  FROM running GROUP BY source, rest),
cuts AS (
  SELECT source, CASE WHEN high - rest < rest - coalesce(low, 0) THEN high_rank ELSE coalesce(low_rank, -1) END AS last_rank
  FROM ends)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST((r.certain + CASE WHEN r.odds > 0 AND r.rank <= c.last_rank THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM ranked r LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
"""

def q_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_captures(table(spark, sf, "pages"), path)
    captures = page_ids(assemble(read_records(spark, path, payload=False)))
    revisits = F.col("response.record_type") == "revisit"
    return captures.select(
        "page_id",
        F.when(revisits, F.col("original.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisits, F.regexp_replace("response.stated_digest", "^sha1:", ""))
        .otherwise(F.col("response.payload_digest"))
        .alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("original_page_id").alias("refers_to"),
    )


WARC_SQL = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM digests)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""

def q_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = round_trip(table(spark, sf, "documents").select("doc_id", "text"), path)
    return coded.select("doc_id", "round_trip.n_tokens", "round_trip.ids_sha256", "round_trip.decoded_sha256")


def q_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = jaccard_components(table(spark, sf, "documents"))
    return joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def q_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    stats = kept(with_statistics(docs, "text", "s").select("doc_id", "s"), "quality-stats")
    rules = learn(labelled_statistics(stats, table(spark, sf, "labels")))
    judged = stats.withColumns({"base_failed": base_failed("s"), "rule": verdict(rules, "s")})
    return judged.select(
        "doc_id", *[f"s.{name}" for name in COUNTS], "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")
    )


def q_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = scored(docs, ~held_out(F.col("doc_id")))
    return rows.select(
        F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def q_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    test = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = predicted(docs.select("doc_id", "text"), learn_languages(docs, ~test))
    return rows.select("doc_id", test.alias("held_out"), "language.lang_pred", "language.score")


def q_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = extracted(table(spark, sf, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def q_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return with_fingerprints(table(spark, sf, "documents")).withColumnRenamed("doc", "doc_id")


def q_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "tokens")
    documents = write_tokens(table(spark, sf, "documents"), folder, path)
    counted = document_counts(documents, token_counts(spark, folder, END_OF_DOCUMENT))
    return counted.select(F.col("doc").alias("doc_id"), "n_tokens", "ordinal", "first_token")


def q_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = with_kept_lines(docs, kept(keep_bitmaps(docs), "line-bitmaps"))
    return rows.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
marked AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def q_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS t
        FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT *, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM starts) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 30),
halves AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)),
cuts AS (
  SELECT h.lang, h.phrase, h.a, x.f AS l, y.f AS r, j, CAST(CAST(2000000 AS HUGEINT) * h.a // (x.f + y.f) AS BIGINT) AS score
  FROM halves h JOIN grams x ON x.lang = h.lang AND x.phrase = h.p JOIN grams y ON y.lang = h.lang AND y.phrase = h.q),
worst AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL),
stay AS (
  SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE NOT coalesce(100 * CAST(i.longer AS HUGEINT) >= 80 * CAST(w.a AS HUGEINT), false))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM stay)
JOIN totals USING (lang) WHERE rank <= 2000
"""


def q_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))


QUERIES = {
    "op12_spelling_variants": q_spelling,
    "op13_phrases": q_phrases,
    "op11_line_dedup": q_line_dedup,
    "op8_token_counts": q_token_counts,
    "op4_fingerprints": q_fingerprints,
    "op2_html_extraction": q_html_extraction,
    "op5_language_id": q_language_id,
    "op9_ppm_scores": q_lm_scores,
    "op6_quality_rules": q_quality_rules,
    "op1_ngram_jaccard_join": q_ngram_join,
    "op3_bpe": q_bpe,
    "op7_warc": q_warc,
    "op10_mix_sources": q_mix_sources,
}

ORACLES = {
    "op13_phrases": PHRASE_SQL,
    "op11_line_dedup": LINE_SQL,
    "op7_warc": WARC_SQL,
    "op10_mix_sources": MIX_SQL,
}
