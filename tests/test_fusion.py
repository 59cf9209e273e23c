import pytest
from pyspark.sql import functions as F

from pairwell.functions.scores import CHANNEL_WEIGHTS
from pairwell.functions.text import tokens
from pairwell.operators.block_join import Limits
from pairwell.operators.bm25 import bm25_topk, term_counts
from pairwell.operators.fusion import channel_counts, explain_sources, rrf
from pairwell.operators.lsh import lsh_topk
from pairwell.operators.vector import vector_topk
from pairwell.plans.hybrid import hybrid_match, prepare_profiles, report, search_channels, with_documents

CHANNEL = "cv_id int, doc_id string, source string, rank int, raw_score double"


@pytest.fixture
def channels(spark):
    return [
        spark.createDataFrame(rows, CHANNEL)
        for rows in (
            [(1, "a", "sem_description_vector", 1, 1.9), (1, "b", "sem_description_vector", 2, 1.5)],
            [(1, "c", "lsh_minhash", 1, 0.4), (1, "a", "lsh_minhash", 2, 0.3)],
        )
    ]


def test_rrf(channels):
    rows = rrf(channels, digits=6).orderBy("rank").collect()
    assert [(r.doc_id, r.rrf_score) for r in rows] == [
        ("a", round(1.2 / 61 + 1.5 / 62, 6)),
        ("c", round(1.5 / 61, 6)),
        ("b", round(1.2 / 62, 6)),
    ]
    assert {k: (v.rank, v.raw_score) for k, v in rows[0].sources.items()} == {
        "sem_description_vector": (1, 1.9),
        "lsh_minhash": (2, 0.3),
    }


def test_rrf_does_not_depend_on_channel_order(channels):
    assert sorted(map(str, rrf(channels).collect())) == sorted(map(str, rrf(channels[::-1]).collect()))


def test_explanation_and_counts(channels):
    why = rrf(channels).filter("doc_id = 'a'").select(explain_sources(F.col("sources"))).first()[0]
    assert why == (
        '{"lsh_minhash":{"rank":2,"raw_score":0.3},"sem_description_vector":{"rank":1,"raw_score":1.9}}'
    )
    assert {r.source: r.hits for r in channel_counts(channels).collect()} == {
        "sem_description_vector": 2,
        "lsh_minhash": 2,
    }


POSTINGS = [
    ("p0", "Backend developer", ["Java", "Spring", "Kafka"], "Builds services and queues", "5 years of services"),
    ("p1", "Account manager", ["Selling", "Customer care"], "Looks after customers", "3 years of selling"),
    ("p2", "Data analyst", ["SQL", "Statistics", "Python"], "Answers questions with data", "2 years with data"),
    ("p3", "Web designer", ["HTML", "CSS", "Figma"], "Draws pages and builds them", "4 years of pages"),
]


def both_sides(spark):
    postings = spark.createDataFrame(
        POSTINGS, "doc_id string, title string, skills array<string>, description string, experience string"
    )
    profiles = spark.createDataFrame(
        [
            (1, "Senior data analyst", ["python ", "SQL"], "data questions", "data for 2 years"),
            (2, "Designer", ["css"], "draws", ""),
            (3, "", [], "", ""),
        ],
        "cv_id int, title string, skills array<string>, description string, experience string",
    )
    stored = prepare_profiles(postings.withColumnRenamed("doc_id", "cv_id"), dim=64)
    return prepare_profiles(profiles, dim=64), stored.withColumnRenamed("cv_id", "doc_id")


def test_hybrid_match(spark):
    profiles, postings = both_sides(spark)
    rows = hybrid_match(profiles, postings).orderBy("cv_id", "rank").collect()
    best = {r.cv_id: r for r in rows if r.rank == 1}
    assert best[1].doc_id == "p2" and best[2].doc_id == "p3"
    assert set(best[1].sources) == {"sem_description_vector", "sem_experience_vector", "lsh_minhash", "bm25"}
    assert "sem_experience_vector" not in best[2].sources
    assert 3 not in best
    assert hybrid_match(profiles, postings, final_k=1).count() == 2


def test_display(spark):
    profiles, postings = both_sides(spark)
    matches = hybrid_match(profiles, postings)
    for limits in (Limits(), Limits(broadcast_bytes=0)):
        shown = report(with_documents(matches, postings, limits))
        first = shown.filter("cv_id = 1 and rank = 1").first()
        assert (first.title, first.skills) == ("Data analyst", "SQL, Statistics, Python")
        assert first.experience == "2 years with data..." and first.why.startswith('{"bm25":{"rank":1')
        assert shown.count() == matches.count()


def test_channels_skip_empty_queries(spark):
    profiles, postings = both_sides(spark)
    channels = search_channels(profiles, postings)
    assert {r.source for r in channels.select("source").distinct().collect()} == set(CHANNEL_WEIGHTS)
    assert channels.filter("cv_id = 3").count() == 0


def stored_with_statistics(spark, postings, folder):
    postings.withColumn("tokens", tokens(F.col("title"))).write.parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings")
    term_counts(stored).write.parquet(f"{folder}/terms")
    return stored, spark.read.parquet(f"{folder}/terms")


def hits_of(channels):
    return {(r.cv_id, r.source, r.rank): (r.doc_id, round(r.raw_score, 9)) for r in channels.collect()}


def test_four_channels_from_one_scan(spark, tmp_path):
    profiles, postings = both_sides(spark)
    stored, stats = stored_with_statistics(spark, postings, tmp_path)
    found = search_channels(profiles, stored, stats=stats)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1
    alone = [
        vector_topk(profiles, postings, 10, v, v, f"sem_{v}") for v in ("description_vector", "experience_vector")
    ]
    sketch = F.col("skills_signature").alias("signature")
    alone.append(lsh_topk(profiles.select("cv_id", sketch), postings.select("doc_id", sketch), 10))
    alone.append(bm25_topk(profiles, postings, 10))
    expected = {}
    for channel in alone:
        expected |= hits_of(channel)
    assert hits_of(found) == hits_of(search_channels(profiles, postings)) == expected
    small = Limits(broadcast_bytes=0, block_bytes=900, scores=2)
    assert hits_of(search_channels(profiles, stored, limits=small, stats=stats)) == expected
