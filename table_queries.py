"""Registered queries: every operator on the given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions.cleaning import clean_location, clean_min_experience, page_count
from pairwell.functions.encode import file_stem, hash_strings, zero_vector
from pairwell.functions.scores import TOP_K_PER_CHANNEL, cosine_plus_one, sketch_jaccard
from pairwell.functions.text import tokens
from pairwell.operators.bm25 import bm25_topk, corpus_stats, corpus_totals
from pairwell.operators.documents import convert_documents
from pairwell.operators.embed import embed_columns, hash_embed, hash_embed_words
from pairwell.operators.frontier import discover_links, merged_history, unseen
from pairwell.operators.fusion import channel_counts, rrf
from pairwell.operators.lsh import lsh_candidate_counts, lsh_topk
from pairwell.operators.once import with_once
from pairwell.operators.pages import extract_page_fields, list_page_urls
from pairwell.operators.pivots import pivot_reach, pivot_topk, write_pivot_index
from pairwell.operators.profiles import extract_profiles, read_replies, rejected_profiles, valid_profiles
from pairwell.operators.sketch import band_table, signature
from pairwell.operators.vector import vector_topk
from pairwell.plans.enrich import enrich
from pairwell.plans.hybrid import hybrid_match, prepare_profiles, report, search_channels, search_columns, with_documents
from pairwell.schemas import POSTING
from pairwell.session import shared_dir, spread
from pairwell.sources.batches import latest, read_batches, write_batch
from pairwell.sources.bulk import bulk_refused, bulk_status, bulk_write
from pairwell.sources.compaction import Folder, compact_postings, removable, remove
from pairwell.sources.files import read_documents, write_json, write_rejects, write_texts
from pairwell.sources.history import append_history, read_history
from pairwell.sources.messages import decode_messages, encode_messages, rejected_messages, valid_messages
from pairwell.sources.postings import append_postings, create_postings_table, read_postings, to_documents
from pairwell.sources.search_index import (
    indexed_bands,
    indexed_bm25_topk,
    indexed_counts,
    indexed_lsh_topk,
    indexed_words,
    write_index,
)
from pairwell.streaming.ingest import batch_status, read_rejects, start_ingest
from pairwell.sources.vectors import VectorStore
from pairwell.streaming.links import new_links, new_links_for, without_empty_batches
from pairwell.streaming.status import BatchListener, ingest_status

DIM = 64
K = TOP_K_PER_CHANNEL
#: The queries round scores before they rank, so that SQL engines that add up in another order agree.
DIGITS = 6


# --- the given tables in the library's shapes ---------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts as profiles, documents as postings."""
    profiles = table(spark, sf, "benchmark").select(F.col("item_id").alias("cv_id"), "text")
    postings = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return profiles, postings


def sketched(df: DataFrame, id_column: str) -> DataFrame:
    words = df.select(id_column, F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    return words.withColumn("signature", signature(F.col("tokens")))


def after_first_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[^\n]*\n", "")


def searchable(df: DataFrame, id_column: str) -> DataFrame:
    """Whole text as title and description, its words as skills, later lines as experience.

    Each text is split into words once: those of the later lines follow those of the first.
    """
    worded = with_once(df.select(id_column, "text"), "tokens", tokens(F.col("text")))
    first = F.size(tokens(F.substring_index("text", "\n", 1)))
    has_lines = F.contains("text", F.lit("\n"))
    later = F.when(has_lines, F.slice("tokens", first + 1, F.size("tokens"))).otherwise(F.col("tokens"))
    words = F.array_distinct("tokens")
    return worded.select(
        id_column,
        F.col("text").alias("title"),
        "tokens",
        words.alias("skills"),
        after_first_line(F.col("text")).alias("experience"),
        signature(words).alias("skills_signature"),
        hash_embed_words(F.col("tokens"), DIM).alias("description_vector"),
        hash_embed_words(later, DIM).alias("experience_vector"),
    )


def posting_messages(documents: DataFrame) -> DataFrame:
    """Documents as raw JSON messages; German ones lack a title, Spanish ones a place."""
    has_place = F.col("lang") != "es"
    message = F.to_json(
        F.struct(
            F.when(F.col("lang") != "de", F.col("text")).alias("title"),
            F.when(has_place, F.concat("source", F.lit("\n 12 lượt xem\n"), "lang")).alias("location"),
            F.concat(F.lit("MÔ TẢ CÔNG VIỆC:\u00a0\n\n"), "text").alias("description"),
            F.array_join(F.array_distinct(tokens(F.col("text"))), " , ").alias("required_skills"),
            F.concat(F.col("n_chars").cast("string"), F.lit(" năm")).alias("min_experience_years"),
            after_first_line(F.col("text")).alias("job_requirements"),
            F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"), F.lit("//?x=1#top")).alias("link"),
        )
    )
    return with_once(documents, "value", message).select("doc_id", "value")


def flat_postings(postings: DataFrame) -> DataFrame:
    return postings.select(
        "posting_id",
        "doc_type",
        "title",
        F.to_json("skills").alias("skills"),
        "skills_text",
        "description",
        F.array_join(F.transform("description_vector", lambda x: x.cast("int").cast("string")), " ").alias(
            "description_vector"
        ),
        "experience",
        "location",
        "experience_years",
        "link",
        F.col("metadata.source").alias("origin"),
    )


# --- searches -----------------------------------------------------------------------------


def q_corpus_stats(spark, sf):
    _, postings = texts(spark, sf)
    return corpus_stats(postings.select(tokens(F.col("text")).alias("tokens")))


def q_corpus_totals(spark, sf):
    _, postings = texts(spark, sf)
    totals = corpus_totals(postings.select(tokens(F.col("text")).alias("tokens")))
    return totals.withColumn("mean_length", F.round("mean_length", 6))


def q_bm25_topk(spark, sf):
    return bm25_topk(*texts(spark, sf), K, "text", "text", digits=DIGITS)


def q_bm25_distinct_terms(spark, sf):
    return bm25_topk(*texts(spark, sf), K, "text", "text", dedup_terms=True, digits=DIGITS)


def q_minhash_signature(spark, sf):
    sketches = sketched(texts(spark, sf)[1], "doc_id")
    return sketches.select("doc_id", F.array_join(hash_strings(F.col("signature")), " ").alias("signature"))


def q_lsh_bands(spark, sf):
    return band_table(sketched(texts(spark, sf)[1], "doc_id"))


def q_lsh_candidates(spark, sf):
    profiles, postings = texts(spark, sf)
    return lsh_candidate_counts(sketched(profiles, "cv_id"), sketched(postings, "doc_id"))


def q_lsh_topk(spark, sf):
    profiles, postings = texts(spark, sf)
    return lsh_topk(sketched(profiles, "cv_id"), sketched(postings, "doc_id"), K, digits=DIGITS)


def q_skill_jaccard_exact(spark, sf):
    profiles, postings = texts(spark, sf)
    return lsh_topk(sketched(profiles, "cv_id"), sketched(postings, "doc_id"), K, verify="exact", digits=DIGITS)


def q_sketch_pairs(spark, sf):
    """Best skill matches scored again by a join with both sides' sketches."""
    profiles, postings = texts(spark, sf)
    cvs, jobs = sketched(profiles, "cv_id"), sketched(postings, "doc_id")
    hits = lsh_topk(cvs, jobs, K, digits=DIGITS).select("cv_id", "doc_id")
    left = cvs.select("cv_id", F.col("signature").alias("own"))
    right = jobs.select("doc_id", F.col("signature").alias("other"))
    pairs = hits.join(left, "cv_id").join(right, "doc_id")
    score = F.round(sketch_jaccard(F.col("own"), F.col("other")), 6)
    return pairs.select("cv_id", "doc_id", score.alias("score"))


def q_vector_pairs(spark, sf):
    """Best vector matches scored again by a join with both sides' vectors."""
    vectors = table(spark, sf, "embeddings")
    hits = q_vector_topk(spark, sf).select("cv_id", "doc_id", "rank")
    left = vectors.select(F.col("vec_id").alias("cv_id"), F.col("embedding").alias("own"))
    right = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("other"))
    pairs = hits.join(left, "cv_id").join(right, "doc_id")
    score = F.round(cosine_plus_one(F.col("own"), F.col("other")), 6)
    return pairs.select("cv_id", "doc_id", "rank", score.alias("score"))


def q_vector_topk(spark, sf):
    """Every embedding as a profile against every embedding as a posting."""
    vectors = table(spark, sf, "embeddings")
    profiles = vectors.select(F.col("vec_id").alias("cv_id"), F.col("embedding").alias("vector"))
    postings = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vector_topk(profiles, postings, K, digits=DIGITS)


def _pivoted(spark, sf):
    vectors = table(spark, sf, "embeddings")
    path = shared_dir(spark, "pivots")
    write_pivot_index(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), path)
    return path, vectors.select(F.col("vec_id").alias("cv_id"), F.col("embedding").alias("vector"))


def q_pivot_topk(spark, sf):
    """Every embedding against all of them, skipping by angles to pivots."""
    path, profiles = _pivoted(spark, sf)
    return pivot_topk(spark, path, profiles, K, digits=DIGITS)


def q_pivot_reach(spark, sf):
    """How many embeddings the first floors leave to score."""
    path, profiles = _pivoted(spark, sf)
    return pivot_reach(spark, path, profiles, K, digits=DIGITS)


def q_hash_embed(spark, sf):
    vector = hash_embed(F.col("text"), DIM)
    whole = F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), " ")
    return texts(spark, sf)[1].select("doc_id", whole.alias("vector"))


def q_model_embed(spark, sf):
    """A caller's model, asked once per distinct text of two columns."""

    def model():
        return lambda batch: [[float(len(text)), float(text.count(" "))] for text in batch]

    documents = texts(spark, sf)[1].withColumn("body", after_first_line(F.col("text")))
    embedded = embed_columns(documents, {"text": "vector", "body": "body_vector"}, model)
    return embedded.select(
        "doc_id",
        F.element_at("body_vector", 1).cast("double").alias("body_characters"),
        F.element_at("vector", 1).cast("double").alias("characters"),
        F.element_at("vector", 2).cast("double").alias("blanks"),
    )


def _channels(spark, sf):
    profiles, postings = texts(spark, sf)
    return search_channels(searchable(profiles, "cv_id"), search_columns(searchable(postings, "doc_id")), digits=DIGITS)


def q_channel_counts(spark, sf):
    return channel_counts([_channels(spark, sf)])


def q_rrf_fusion(spark, sf):
    fused = rrf([_channels(spark, sf)], digits=DIGITS)
    hits = fused.select("cv_id", "doc_id", "rank", "rrf_score", F.explode("sources").alias("source", "hit"))
    return hits.select(
        "cv_id",
        "doc_id",
        "rank",
        "rrf_score",
        "source",
        F.col("hit.rank").alias("source_rank"),
        F.col("hit.raw_score").alias("raw_score"),
    )


def q_hybrid_match(spark, sf):
    profiles, postings = texts(spark, sf)
    matches = hybrid_match(searchable(profiles, "cv_id"), search_columns(searchable(postings, "doc_id")), digits=DIGITS)
    return matches.drop("sources")


def q_match_report(spark, sf):
    profiles, postings = texts(spark, sf)
    cvs, jobs = searchable(profiles, "cv_id"), searchable(postings, "doc_id")
    return report(with_documents(hybrid_match(cvs, search_columns(jobs), digits=DIGITS), jobs))


# --- links and pages ----------------------------------------------------------------------


def _found_links(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    crawled = F.col("url").startswith("https:")
    old = discover_links(pages.filter(crawled), include="/", exclude=",", scope=None)
    new = discover_links(pages.filter(~crawled), include="/", exclude=",", scope=None)
    return old, new


def q_discover_links(spark, sf):
    return discover_links(spread(table(spark, sf, "pages")), include="/", exclude=",", scope=None)


def q_scoped_links(spark, sf):
    """Links inside the element of English pages, resolved against the page's address."""
    pages = spread(table(spark, sf, "pages"))
    return discover_links(pages, include="/", exclude=",", scope=("html", "lang", "en"), base="url")


def q_url_frontier(spark, sf):
    """Links of the http pages that no https page has."""
    old, new = _found_links(spark, sf)
    return unseen(new, old)


def q_merged_history(spark, sf):
    old, new = _found_links(spark, sf)
    return merged_history(old, unseen(new, old))


def q_page_urls(spark, sf):
    """List pages when each order priority is a site and its orders are postings."""
    orders = table(spark, sf, "orders").groupBy("o_orderpriority").count()
    totals = orders.select("o_orderpriority", F.format_number("count", 0).alias("total"))
    return list_page_urls(totals, "total", "http://host/list?page={page}")


def q_page_count(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy("l_suppkey").count()
    return totals.select("l_suppkey", page_count(F.format_number("count", 0)).alias("pages"))


def q_page_fields(spark, sf):
    rules = {
        "title": [r"(?s)<h1\b[^>]*>(.*?)</h1>", r"(?s)<title>(.*?)</title>"],
        "location": [r'<html lang="([^"]*)"'],
        "description": [r"(?s)<article\b[^>]*>(.*?)</article>"],
        "required_skills": [r"(?s)<nav\b[^>]*>(.*?)</nav>"],
        "min_experience_years": [r"(?s)<em>(.*?)</em>", r"track\((\d+)\)"],
        "job_requirements": [r"(?s)<section>(.*?)</section>", r"(?s)<aside>(.*?)</aside>", r"(?s)<footer>(.*?)</footer>"],
    }
    return extract_page_fields(spread(table(spark, sf, "pages")), rules)


def q_convert_documents(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    path = F.concat(F.lit("crawl/"), F.col("page_id").cast("string"), F.lit(".v1.HTML"))
    files = pages.select(path.alias("path"), F.encode("html", "UTF-8").alias("content"))
    return convert_documents(files)


def q_converted_texts(spark, sf):
    """Pages through a caller's converter that refuses some; texts and rejects are written and read back."""
    pages = spread(table(spark, sf, "pages"))
    files = pages.select(
        F.concat(F.lit("crawl/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )

    def converter():
        def to_text(content):
            if b"</html>" not in content:
                raise ValueError("cut off")
            return content.decode().partition("<title>")[2].partition("</title>")[0]

        return to_text

    converted = convert_documents(files, converter, on_error="keep")
    base = shared_dir(spark, "converted")
    write_texts(converted.filter("error IS NULL"), f"{base}/texts")
    write_rejects(converted.filter("error IS NOT NULL").select("path", "error"), f"{base}/rejects")
    texts_back = spark.read.parquet(f"{base}/texts").select("stem", "text", F.lit(None).cast("string").alias("error"))
    rejects_back = spark.read.schema("path string, error string").parquet(f"{base}/rejects")
    stem = file_stem(F.col("path"))
    return texts_back.unionByName(rejects_back.select(stem.alias("stem"), F.lit(None).cast("string").alias("text"), "error"))


def q_stored_history(spark, sf):
    """Links of http pages as a history in two appends, read back."""
    _, new = _found_links(spark, sf)
    path = f"{shared_dir(spark, 'history')}/links"
    append_history(new.filter("page_id % 2 = 0"), path)
    append_history(new.filter("page_id % 2 = 1"), path)
    return read_history(spark, path).groupBy("url").agg(F.count("*").alias("times"))


# --- profiles -----------------------------------------------------------------------------


def _resumes(spark, sf):
    """Conversation turns as Markdown résumés; some roles lack a section."""
    turns = spread(table(spark, sf, "conversations"))
    words = F.array_join(F.array_distinct(tokens(F.col("text"))), "\n- ")
    skills = F.when(F.col("role") != "system", F.concat(F.lit("\n## Skills\n- "), words))
    experience = F.when(F.col("role") != "assistant", F.concat(F.lit("\n## Work history\n"), "text"))
    markdown = F.concat_ws(
        "", F.lit("# "), "role", F.lit(" "), "conv_id", skills, F.lit("\n## Summary:\n"), "text", experience
    )
    return with_once(turns, "resume", markdown).select("conv_id", "turn", "resume")


def q_profile_extract(spark, sf):
    found = valid_profiles(extract_profiles(_resumes(spark, sf), "resume"), "conv_id", "turn")
    return found.withColumn("skills", F.array_join("skills", " "))


def q_profile_rejects(spark, sf):
    return rejected_profiles(extract_profiles(_resumes(spark, sf), "resume"), "conv_id", "turn")


def _replies(spark, sf):
    """Conversation turns as JSON replies; some roles lack a field or are no JSON."""
    turns = spread(table(spark, sf, "conversations"))
    reply = F.to_json(
        F.struct(
            F.col("role").alias("title"),
            tokens(F.col("text")).alias("skills"),
            F.when(F.col("role") != "system", F.col("text")).alias("description"),
            F.when(F.col("role") != "user", F.col("text")).alias("experience"),
        )
    )
    reply = F.when(F.col("turn") == 0, F.concat(F.lit("Sure: "), reply)).otherwise(reply)
    turns = with_once(turns, "reply", reply).select("conv_id", "turn", "reply")
    return read_replies(turns, "reply")


def q_profile_replies(spark, sf):
    found = valid_profiles(_replies(spark, sf), "conv_id", "turn")
    return found.withColumn("skills", F.array_join("skills", " "))


def q_profile_reply_rejects(spark, sf):
    return rejected_profiles(_replies(spark, sf), "conv_id", "turn")


# --- messages, postings, streams ----------------------------------------------------------


def q_decode_messages(spark, sf):
    documents = spread(table(spark, sf, "documents"))
    return valid_messages(decode_messages(posting_messages(documents))).drop("value")


def q_decode_rejects(spark, sf):
    """Plain texts and JSON objects in one stream of messages: the texts are rejected."""
    plain = table(spark, sf, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("value")
    )
    objects = table(spark, sf, "events").select(
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("value")
    )
    numbers = table(spark, sf, "events").select(
        F.concat(F.lit("user "), F.col("event_id").cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("value"),
    )
    messages = plain.unionByName(objects).unionByName(numbers)
    return rejected_messages(decode_messages(messages), "id")


def q_clean_posting(spark, sf):
    messages = posting_messages(spread(table(spark, sf, "documents")))
    return flat_postings(enrich(valid_messages(decode_messages(messages)), dim=DIM))


def q_clean_location(spark, sf):
    """Conversation texts, which have many lines, as locations."""
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", clean_location(F.col("text")).alias("location"))


def q_publish_json(spark, sf):
    events = table(spark, sf, "events")
    rows = events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "props"
    )
    return encode_messages(rows)


def q_index_documents(spark, sf):
    """Enriched documents in the JSON form of a document store, at a fixed time."""
    messages = posting_messages(spread(table(spark, sf, "documents")))
    postings = enrich(valid_messages(decode_messages(messages)), dim=DIM)
    at = F.to_utc_timestamp(F.lit("2024-01-31 15:00:00").cast("timestamp"), "UTC")
    moment = F.from_utc_timestamp(at, F.current_timezone())
    fixed = F.struct("metadata.source", moment.alias("indexed_at"))
    return to_documents(postings.withColumn("metadata", fixed))


def q_catalog_postings(spark, sf):
    """Enriched documents bulk-loaded under their own ids into a catalog table."""
    name = f"postings_{uuid.uuid4().hex}"
    messages = posting_messages(spread(table(spark, sf, "documents")))
    create_postings_table(spark, name)
    rows = enrich(valid_messages(decode_messages(messages)), dim=4)
    append_postings(rows, name, 7)
    stored = spark.table(name).select("posting_id", "title", F.size("skills").alias("n_skills"), "batch_id")
    path = shared_dir(spark, "catalog")
    stored.write.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path)


def q_json_lines(spark, sf):
    """Conversations as JSON lines, read back by their schema."""
    turns = table(spark, sf, "conversations")
    path = shared_dir(spark, "json")
    write_json(turns, path)
    return spark.read.schema(turns.schema).json(path)


def q_zero_queries(spark, sf):
    """Texts without words as zero vectors: they stand for no query and match nothing."""
    profiles, postings = texts(spark, sf)
    vector = F.when(F.col("cv_id") % 2 == 0, zero_vector(DIM)).otherwise(hash_embed(F.col("text"), DIM))
    stored = postings.select("doc_id", hash_embed(F.col("text"), DIM).alias("vector"))
    found = vector_topk(profiles.select("cv_id", vector.alias("vector")), stored, 1, digits=DIGITS)
    return found.select("cv_id", "doc_id", "rank")


def q_model_profiles(spark, sf):
    """Conversation turns through a caller's model that answers in JSON, and not always."""

    def model():
        def answer(batch):
            return [
                json.dumps({"title": t.split(" ")[0], "skills": ["x"], "description": str(len(t)), "experience": ""})
                if len(t) % 3
                else "no"
                for t in batch
            ]

        return answer

    turns = spread(table(spark, sf, "conversations")).select("conv_id", "turn", "text")
    found = extract_profiles(turns, "text", model)
    return found.select("conv_id", "turn", F.col("profile.title").alias("title"), F.col("profile.description").alias("description"), "reason")


def q_latest_postings(spark, sf):
    """Copies of a text as one posting that was sent again in later batches."""
    documents = table(spark, sf, "documents")
    rows = documents.select(F.sha2("text", 256).alias("posting_id"), F.col("doc_id").alias("batch_id"), "n_chars")
    return latest(rows)


def _number() -> Column:
    """The document's id, from the link of its posting."""
    return F.regexp_extract("link", r"/(\d+)//", 1).cast("long")


def _enriched(messages: DataFrame, part: Column, dim: int) -> DataFrame:
    """Postings of some messages; the others are not made."""
    return enrich(valid_messages(decode_messages(messages.filter(part))), dim=dim)


def _batch(spark, path: str, batch_id: int) -> DataFrame:
    """Postings of a batch that is written, to take others from: enriching is costly."""
    return read_batches(spark, path, POSTING).filter(F.col("batch_id") == batch_id).drop("batch_id")


def _stream(spark, sf, name):
    """A table, which may be one file or a folder of files, as a stream."""
    schema = table(spark, sf, name).schema
    # A pattern, because Spark takes a stream's plain path for a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _spread_stream(spark, sf, name):
    """As ``_stream``, dealt over the cores where the table has fewer splits, as ``spread`` does."""
    rows, cores = _stream(spark, sf, name), spark.sparkContext.defaultParallelism
    return rows if table(spark, sf, name).rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _ingested(spark, sf):
    """Documents twice in a stream: as posting messages and as plain text."""
    documents = _stream(spark, sf, "documents")
    good = posting_messages(_spread_stream(spark, sf, "documents")).select("value")
    plain = documents.select(F.col("text").alias("value"))
    base = shared_dir(spark, "ingest")
    paths = f"{base}/postings", f"{base}/rejects"
    cores = spark.sparkContext.defaultParallelism
    ingest = start_ingest(good.union(plain), *paths, f"{base}/checkpoint", ["value"], dim=DIM, tasks=cores)
    ingest.awaitTermination()
    return paths


def q_stream_enrich(spark, sf):
    postings, _ = _ingested(spark, sf)
    return flat_postings(read_postings(spark, postings))


def q_compacted_postings(spark, sf):
    """Two halves of the documents as batches with a compaction between; the second sends some postings again."""
    messages = posting_messages(spread(table(spark, sf, "documents")))
    base = shared_dir(spark, "compacted")
    number, doc_id = _number(), F.col("doc_id")
    # Rows that several batches have are enriched for the first one, and taken from it.
    write_batch(_enriched(messages, doc_id % 2 == 0, 4), f"{base}/batches", 0)
    first = _batch(spark, f"{base}/batches", 0)
    write_batch(first.filter(number % 4 == 0).withColumn("title", F.lit("again")), f"{base}/batches", 1)
    compact_postings(spark, f"{base}/batches", f"{base}/current", 1 << 20)
    later = _enriched(messages, doc_id % 2 == 1, 4).unionByName(first.filter(number % 6 == 0))
    later = later.withColumn("doc_type", F.when(number % 3 == 0, "job").otherwise("cv"))
    write_batch(later, f"{base}/batches", 2)
    found = read_postings(spark, f"{base}/batches", compacted=f"{base}/current")
    return found.select("posting_id", "title", "doc_type")


def q_incremental_compaction(spark, sf):
    """Three batches, compacted one after the other; what the last manifest does not need is removed."""
    messages = posting_messages(spread(table(spark, sf, "documents")))
    rows = enrich(valid_messages(decode_messages(messages)), dim=4)
    number = F.regexp_extract("link", r"/(\d+)//", 1).cast("long")
    base = shared_dir(spark, "incremental")
    batches, current = f"{base}/batches", f"{base}/current"
    later = rows.filter((number % 2 == 1) | (number % 6 == 0)).withColumn("doc_type", F.when(number % 3 == 0, "job").otherwise("cv"))
    again = rows.filter(number % 4 == 0).withColumn("title", F.lit("again"))
    for batch, part in enumerate((rows.filter(number % 2 == 0), again, later)):
        write_batch(part, batches, batch)
        compact_postings(spark, batches, current, 1 << 20)
        remove(spark, removable(spark, batches, current))
    return read_postings(spark, batches, compacted=current).select("posting_id", "title", "doc_type")


def _prepared(spark, sf):
    return prepare_profiles(
        texts(spark, sf)[0].select(
            "cv_id",
            F.col("text").alias("title"),
            F.array_distinct(tokens(F.col("text"))).alias("skills"),
            F.col("text").alias("description"),
            after_first_line(F.col("text")).alias("experience"),
        ),
        dim=DIM,
    )


def q_stored_match(spark, sf):
    """Search on the stored table: ingest as a stream, read back, match every profile."""
    path, _ = _ingested(spark, sf)
    postings = read_postings(spark, path).withColumnRenamed("posting_id", "doc_id")
    return hybrid_match(_prepared(spark, sf), postings, digits=DIGITS).drop("sources")


def _indexed(spark, sf):
    """Documents as postings of two batches and their index; the second sends some again."""
    messages = posting_messages(spread(table(spark, sf, "documents")))
    base = shared_dir(spark, "indexed")
    number, only_first = _number(), F.col("doc_id") % 6 == 4
    once = number % 6 == 4
    # The second batch is written first: rows that both have are enriched for it, and taken from it.
    write_batch(_enriched(messages, ~only_first, DIM), f"{base}/postings", 1)
    early = _batch(spark, f"{base}/postings", 1).unionByName(_enriched(messages, only_first, DIM)).filter(number % 3 != 0)
    # What the second batch replaces has other words and skills in the first.
    older = early.withColumns({"title": F.when(once, F.col("title")).otherwise(F.lit("older words"))})
    write_batch(older, f"{base}/postings", 0)
    for batch in (0, 1):
        write_index(read_batches(spark, f"{base}/postings", POSTING).filter(F.col("batch_id") == batch), f"{base}/index", batch)
    return f"{base}/postings", f"{base}/index"


def q_stored_bands(spark, sf):
    """Band rows of the stored postings, from their index."""
    _, index = _indexed(spark, sf)
    return indexed_bands(spark, index)


def q_stored_lsh(spark, sf):
    """Skill search through the stored band rows."""
    path, index = _indexed(spark, sf)
    signature_of = F.col("skills_signature").alias("signature")
    postings = read_postings(spark, path).select(F.col("posting_id").alias("doc_id"), signature_of)
    profiles = _prepared(spark, sf).select("cv_id", signature_of)
    return indexed_lsh_topk(indexed_bands(spark, index), profiles, postings, K, digits=DIGITS)


def q_stored_bm25(spark, sf):
    """Keyword search on stored words and statistics."""
    _, index = _indexed(spark, sf)
    return indexed_bm25_topk(spark, index, texts(spark, sf)[0], K, digits=DIGITS, profile_text="text")


def q_stored_terms(spark, sf):
    """Statistics of the stored titles, summed over batches."""
    _, index = _indexed(spark, sf)
    return indexed_counts(spark, index).select("term", "docs", "tokens")


def q_stored_one_scan(spark, sf):
    """All four channels over the stored postings with their stored words and statistics: one scan."""
    path, index = _indexed(spark, sf)
    postings = read_postings(spark, path).join(indexed_words(spark, index), "posting_id").withColumnRenamed("posting_id", "doc_id")
    stats = indexed_counts(spark, index)
    return hybrid_match(_prepared(spark, sf), search_columns(postings), digits=DIGITS, stats=stats).drop("sources")


def q_stream_rejects(spark, sf):
    _, rejects = _ingested(spark, sf)
    return read_rejects(spark, rejects).select(F.sha2("value", 256).alias("value_hash"), "reason")


def q_stream_status(spark, sf):
    postings, rejects = _ingested(spark, sf)
    status = batch_status(read_batches(spark, postings, POSTING), read_rejects(spark, rejects))
    return status.agg(F.sum("saved").alias("saved"), F.sum("rejected").alias("rejected"))


def q_stream_balance(spark, sf):
    """Where every message of a stream went: documents, plain texts, repeats with a newer text, and blanks."""
    documents = _stream(spark, sf, "documents")
    good = posting_messages(_spread_stream(spark, sf, "documents")).select("value")
    again = good.filter(F.col("value").contains("//?x=1#top")).select(F.concat("value", F.lit(" ")).alias("value"))
    plain = documents.select(F.col("text").alias("value"))
    blank = documents.filter("doc_id % 3 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.lit("")).alias("value"))
    base = shared_dir(spark, "balance")
    paths = [f"{base}/{name}" for name in ("postings", "rejects", "checkpoint")]
    listener = BatchListener(spark, f"{base}/status")
    spark.streams.addListener(listener)
    try:
        messages = good.union(again).union(plain).union(blank)
        ingest = start_ingest(messages, *paths, ["value"], dim=4, status_path=f"{base}/status")
        ingest.awaitTermination()
        listener.wait(str(ingest.runId))
    finally:
        spark.streams.removeListener(listener)
    counts = ["received", "empty", "saved", "rejected", "replaced", "missing"]
    return ingest_status(spark, f"{base}/status").agg(*[F.sum(c).alias(c) for c in counts])


def q_stored_vectors(spark, sf):
    """A caller's model over two batches that share texts; the store answers for those it knows."""
    calls = spark.sparkContext.accumulator(0)

    def model():
        def vectors(batch):
            calls.add(len(batch))
            return [[float(len(text)), float(text.count(" "))] for text in batch]

        return vectors

    documents = texts(spark, sf)[1].withColumn("body", after_first_line(F.col("text")))
    store = VectorStore(shared_dir(spark, "vector-store"), "lengths-1")
    for part in ("doc_id % 2 = 0", "doc_id % 3 = 0"):
        embed_columns(documents.filter(part), {"text": "vector"}, model, store=store)
    before = calls.value
    rows = embed_columns(documents, {"text": "vector", "body": "body_vector"}, model, store=store)
    found = rows.select(
        "doc_id",
        F.element_at("vector", 1).cast("double").alias("characters"),
        F.element_at("body_vector", 2).cast("double").alias("body_blanks"),
    )
    return found.withColumns({"first_calls": F.lit(before).cast("long"), "last_calls": F.lit(calls.value - before).cast("long")})


def q_stream_links(spark, sf):
    """Links of a stream of pages, each once, without those of the https pages."""
    pages = _stream(spark, sf, "pages")
    old, _ = _found_links(spark, sf)
    fresh = new_links(
        discover_links(pages.filter(~F.col("url").startswith("https:")), include="/", exclude=",", scope=None), old
    )
    base = shared_dir(spark, "links")
    writer = fresh.select("url_key").writeStream.format("parquet").option("path", f"{base}/links")
    writer = writer.option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url_key string").parquet(f"{base}/links")


def q_stream_links_ttl(spark, sf):
    """As stream_links, with keys that the state forgets after a day."""
    pages = _stream(spark, sf, "pages")
    old, _ = _found_links(spark, sf)
    found = discover_links(pages.filter(~F.col("url").startswith("https:")), include="/", exclude=",", scope=None)
    base = shared_dir(spark, "links-ttl")
    writer = new_links_for(found, 86_400_000, old).select("url_key").writeStream.format("parquet").option("path", f"{base}/links")
    with without_empty_batches(spark):
        writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url_key string").parquet(f"{base}/links")


def _sent(spark, sf):
    """Documents to a store that refuses German ones, in two batches; the second is sent twice."""

    def open_sink():
        def send(rows):
            found = {i: json.loads(document)["lang"] for i, document in rows}
            return {i: f"no {lang}" for i, lang in found.items() if lang == "de"}

        return send

    body = F.to_json(F.struct("text", "lang", "source"))
    documents = spread(table(spark, sf, "documents")).select("doc_id", F.col("doc_id").cast("string").alias("id"), body.alias("document"))
    path = shared_dir(spark, "bulk")
    for batch in (0, 1, 1):
        bulk_write(documents.filter(F.col("doc_id") % 2 == batch), open_sink, path, batch, chunk=100)
    return path


def q_bulk_refused(spark, sf):
    """What a store refuses of the documents, with its reasons."""
    return bulk_refused(spark, _sent(spark, sf)).select("id", "reason")


def q_bulk_status(spark, sf):
    return bulk_status(spark, _sent(spark, sf))


def q_posting_pages(spark, sf):
    """Documents as posting pages with the labels that the shipped selectors look for."""
    documents = spread(table(spark, sf, "documents"))

    number = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<h1 name="title">job '), number, F.lit("</h1><a>Nộp đơn</a><div>1</div><div>2</div><div>3</div><div>4</div><div>"),
        F.concat(F.lit("about "), F.col("lang")), F.lit("<br>"), number,
        F.lit("</div><h2>Địa điểm làm việc</h2><div>1</div><div>2</div><div>"), F.col("source"), F.lit("</div>"),
        F.lit("<span>KỸ NĂNG</span><p>"), F.concat(F.col("lang"), F.lit(", SQL")), F.lit("</p>"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("<span>SỐ NĂM KINH NGHIỆM TỐI THIỂU</span><p>"), (F.col("doc_id") % 7).cast("string"), F.lit("</p>"))).otherwise(F.lit("")),
        F.lit("<h2>Yêu cầu công việc</h2><div>needs "), F.col("lang"), F.lit("</div>"),
    )
    return extract_page_fields(documents.select(F.concat(F.lit("http://h/"), number).alias("url"), html.alias("html")))


def q_message_values(spark, sf):
    """Messages whose years are JSON numbers, texts, explicit nulls or absent, decoded."""
    documents = table(spark, sf, "documents")
    years = (
        F.when(F.col("doc_id") % 5 == 0, F.lit("null"))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("-"), F.col("n_chars").cast("string")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.col("n_chars").cast("string"), F.lit(".5")))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('"2-'), F.col("n_chars").cast("string"), F.lit('"')))
    )
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit('"link": "http://h/'), F.col("doc_id").cast("string"), F.lit('"')),
        F.when(F.col("doc_id") % 2 == 0, F.lit('"title": null')),
        F.when(F.col("doc_id") % 3 == 0, F.lit('"required_skills": null')),
        F.concat(F.lit('"min_experience_years": '), years),
    )
    messages = documents.select(F.concat(F.lit("{"), parts, F.lit("}")).alias("value"))
    found = valid_messages(decode_messages(messages))
    cleaned = clean_min_experience(F.col("min_experience_years"), F.col("min_experience_number"))
    return found.select("link", "title", "required_skills", "min_experience_years", "min_experience_number", cleaned.alias("years"))


def q_document_files(spark, sf):
    """Files with a suffix in any case, in nested folders, written and found again."""
    path = shared_dir(spark, "document-files")
    turns = table(spark, sf, "conversations").filter("turn < 4").select("conv_id", "turn", "role", "text")
    for suffix, part in ((".TXT", "role = 'user'"), (".txt", "role = 'assistant'"), (".md", "role = 'system'")):
        named = turns.filter(part).select(F.concat_ws("|", "conv_id", "turn", "text").alias("value"))
        store = f"{path}/{suffix[1:].lower()}/{len(part)}"
        named.coalesce(2).write.option("lineSep", "\u0001").text(f"{store}/lines")
        for file in spark.read.text(f"{store}/lines").inputFiles():
            Folder(spark, file).rename(file[: -len(".txt")] + suffix)
    files = read_documents(spark, path, ".txt")
    rows = files.select(F.explode(F.split(F.decode("content", "UTF-8"), "\u0001")).alias("row")).filter("row <> ''")
    split = F.split("row", r"\|", 3)
    return rows.select(split[0].cast("long").alias("conv_id"), split[1].cast("int").alias("turn"), split[2].alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name.removeprefix("q_"): query for name, query in list(globals().items()) if name.startswith("q_")
}
