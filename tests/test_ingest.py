import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from pairwell.operators.embed import embed, embed_columns, hash_embed
from pairwell.plans.enrich import enrich
from pairwell.plans.hybrid import hybrid_match, prepare_profiles
from pairwell.schemas import POSTING
from pairwell.sources.messages import (
    decode_messages,
    encode_messages,
    last_per_posting,
    publish,
    read_topic,
    rejected_messages,
    valid_messages,
    write_topic,
)
from pairwell.sources import batches, compaction
from pairwell.sources import messages as messages_module
from pairwell.sources.batches import latest, read_batches, write_batch
from pairwell.sources.bulk import BulkWriter, bulk_refused, bulk_status, bulk_write
from pairwell.sources.compaction import compact_postings
from pairwell.sources.postings import append_postings, create_postings_table, read_postings, to_documents
from pairwell.sources.vectors import VectorStore
from pairwell.streaming.ingest import batch_status, read_rejects, start_ingest, store_batch
from pairwell.streaming.status import BatchListener, ingest_status

FULL = {
    "title": "Kỹ sư",
    "location": "Hà Nội\n12 lượt xem",
    "description": "Mô tả công việc: Làm\n\nviệc",
    "required_skills": "Python, ,SQL",
    "min_experience_years": "2-3 năm",
    "job_requirements": "Ba năm",
    "link": "http://h/1/?a=1",
}


# One JSON value must be the whole message.
TRAILING = ['{"title":"x"} y', '{"title":"x"}{"title":"y"}', '{"title":"x"}]', '{"title":"x"}, 5', "4 you", '{"a":1}}']


def decoded(spark, values):
    return decode_messages(spark.createDataFrame([(v,) for v in values], "value string"))


def test_defaults_only_for_absent_keys(spark):
    rows = decoded(spark, ["{}", '{"title":null}', '{"title":""}', '{"title":"x"}']).collect()
    assert [r.title for r in rows] == ["Unknown", None, "", "x"]
    assert rows[0].min_experience_years == "0" and rows[0].location == ""


def test_rejects_and_dropped_messages(spark):
    every = decoded(spark, ["{bad", "", None, "7", "[1]", json.dumps(FULL), *TRAILING, " {}\n"])
    assert {r.value: r.reason for r in rejected_messages(every).collect()} == {
        "{bad": "not JSON",
        "7": "not an object",
        "[1]": "not an object",
    } | {value: "not JSON" for value in TRAILING}
    assert valid_messages(every).count() == 2


def test_enrich(spark):
    odd = {"title": 5, "location": 7, "required_skills": None, "min_experience_years": -2, "job_requirements": None}
    rows = enrich(valid_messages(decoded(spark, [json.dumps(FULL), json.dumps(odd), "{}"])), dim=16)
    assert rows.schema.names == POSTING.names
    by_title = {r.title: r for r in rows.collect()}
    full, other, empty = by_title["Kỹ sư"], by_title["5"], by_title["Unknown"]
    assert full.skills == ["Python", "", "SQL"] and full.skills_text == "Python  SQL"
    assert full.location == "Hà Nội" and full.description == "Làm\nviệc" and full.experience_years == 2
    assert full.doc_type == "job" and full.metadata.source == "job_description" and full.metadata.indexed_at
    assert len(full.description_vector) == 16 and len(full.skills_signature) == 128
    assert other.location == "" and other.skills == [] and other.experience_years == -2
    assert other.experience is None and other.experience_vector is None
    assert empty.description_vector is None and empty.experience == "" and empty.experience_years == 0


def test_message_round_trip(spark):
    frame = spark.createDataFrame([tuple(FULL.values())], ", ".join(f"{k} string" for k in FULL))
    (row,) = encode_messages(frame).collect()
    assert row.key is None and json.loads(row.value) == FULL
    (back,) = valid_messages(decode_messages(encode_messages(frame))).collect()
    assert {k: back[k] for k in FULL} == FULL


def test_last_message_of_a_posting_wins(spark):
    values = [json.dumps({"title": t, "link": link}) for t, link in [("a", "http://h/1"), ("b", "http://h/1#x")]]
    values += [json.dumps({"title": "c"}), json.dumps({"title": "d"})]
    frame = spark.createDataFrame(list(enumerate(values)), "offset int, value string")
    rows = last_per_posting(valid_messages(decode_messages(frame)), ["offset"]).collect()
    assert sorted(r.title for r in rows) == ["b", "c", "d"]


def test_hash_embedding(spark):
    frame = spark.createDataFrame([("a b a",), ("A, b! a",), ("",), (None,)], "text string")
    vectors = [r[0] for r in frame.select(hash_embed(F.col("text"), 32)).collect()]
    assert vectors[0] == vectors[1] and sum(abs(x) for x in vectors[0]) in (1, 3)
    assert vectors[2] == vectors[3] == [0.0] * 32
    kept = [r.v for r in embed(frame, "text", "v", dim=32).collect()]
    assert kept[2] is None and kept[3] is None and kept[0] == vectors[0]


def test_model_sees_each_text_once(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        import uuid

        def model(texts):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            return [[float(len(t))] for t in texts]

        return model

    rows = [(i, "copy" if i % 3 else f"text {i}") for i in range(60)] + [(60, ""), (61, None)]
    frame = spark.createDataFrame(rows, "id int, text string").repartition(4)
    got = {r.id: r.v for r in embed(frame, "text", "v", factory).collect()}
    assert got == {i: [float(len(t))] if t else None for i, t in rows}
    seen = [line for name in os.listdir(log) for line in open(f"{log}/{name}").read().split("\n")]
    assert sorted(seen) == sorted({t for _, t in rows if t})


def counting_model(log):
    """A model that writes down every text it is asked for."""

    def factory():
        import uuid

        def model(texts):
            if any("poison" in t for t in texts):
                raise ValueError("bad text")
            with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return factory


def asked(log):
    return sorted(line for name in os.listdir(log) for line in open(f"{log}/{name}").read().split("\n"))


def test_ingest_and_search_ask_the_model_once_per_text(spark, tmp_path):
    logs = [tmp_path / name for name in ("a", "b")]
    for log in logs:
        log.mkdir()
    bodies = [{"title": f"t{i % 5}", "description": f"d{i % 7}", "job_requirements": f"d{i % 3}", "link": f"http://h/{i}"} for i in range(20)]
    messages = spark.createDataFrame([(json.dumps(b),) for b in bodies], "value string")
    store_batch(messages, str(tmp_path / "p"), str(tmp_path / "r"), 0, ["value"], counting_model(logs[0]), 2)
    assert asked(logs[0]) == sorted({b["description"] for b in bodies} | {b["job_requirements"] for b in bodies})
    postings = read_postings(spark, str(tmp_path / "p")).withColumnRenamed("posting_id", "doc_id")
    cvs = spark.createDataFrame([(i, f"t{i}", ["x"], f"q{i % 4}", f"q{i % 3}") for i in range(10)], "cv_id int, title string, skills array<string>, description string, experience string")
    found = hybrid_match(prepare_profiles(cvs, counting_model(logs[1]), 2), postings)
    assert found.count() > 0 and found.collect()
    assert asked(logs[1]) == ["q0", "q1", "q2", "q3"]


def test_texts_that_the_model_refuses(spark, tmp_path):
    rows = [(1, "good"), (2, "poison"), (3, None), (4, "fine")]
    frame = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    factory = counting_model(str(tmp_path))
    got = {r.id: r.v for r in embed(frame, "text", "v", factory, 2, on_error="zero").collect()}
    assert got == {1: [4.0, 1.0], 2: [0.0, 0.0], 3: None, 4: [4.0, 1.0]}
    rejected = {r.id: (r.v, r.embed_error) for r in embed_columns(frame, {"text": "v"}, factory, 2, on_error="reject").collect()}
    assert rejected[2] == (None, "bad text") and rejected[1] == ([4.0, 1.0], None) and rejected[3] == (None, None)
    with pytest.raises(Exception, match="bad text"):
        embed(frame, "text", "v", factory, 2)
    with pytest.raises(ValueError):
        embed(frame, "text", "v", on_error="ignore")


def test_refused_texts_become_rejects_of_the_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    bodies = [{"description": d, "link": f"http://h/{d}"} for d in ("good", "poison")]
    messages = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("{",)], "value string")
    paths = str(tmp_path / "p"), str(tmp_path / "r")
    store_batch(messages, *paths, 0, ["value"], counting_model(str(log)), 2, on_error="reject")
    assert [r.description for r in read_postings(spark, paths[0]).collect()] == ["good"]
    assert sorted(r.reason for r in read_rejects(spark, paths[1]).collect()) == ["embedder: bad text", "not JSON"]


def test_postings_with_other_query_strings_are_others(spark, tmp_path):
    links = ["http://h/x?a=1", "http://h/x?a=2", "/", "?a=1", "http://h/x", "http://h/x/", "http://h/x?a=1#top", "#only", "/"]
    messages = spark.createDataFrame([(json.dumps({"title": f"t{i}", "link": x}),) for i, x in enumerate(links)], "value string")
    store_batch(messages, str(tmp_path / "p"), str(tmp_path / "r"), 0, ["value"], dim=2)
    titles = {r.title for r in read_postings(spark, str(tmp_path / "p")).collect()}
    assert titles == {"t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8"}


def test_messages_of_several_partitions_follow_by_time(spark):
    rows = [("a", "2024-01-01 00:00:01", 0, 900), ("b", "2024-01-01 00:00:02", 1, 3), ("c", "2024-01-01 00:00:02", 0, 901)]
    values = [(json.dumps({"title": t, "link": "http://h/1"}), at, p, o) for t, at, p, o in rows]
    frame = spark.createDataFrame(values, "value string, timestamp string, partition int, offset long")
    (last,) = last_per_posting(valid_messages(decode_messages(frame)), ["timestamp", "partition", "offset"]).collect()
    assert last.title == "b"


def test_publish_to_any_sink(spark, tmp_path):
    path = str(tmp_path / "sink")
    publish(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "parquet", {"path": path})
    publish(spark.createDataFrame([(3, "y")], "a int, b string"), "parquet", {"path": path}, ["a"])
    rows = spark.read.parquet(path).collect()
    assert {r.key for r in rows} == {None} and sorted(r.value for r in rows) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}', '{"a":3}']


def test_catalog_table(spark, tmp_path):
    name = "pairwell_postings_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        assert create_postings_table(spark, name) and not create_postings_table(spark, name)
        rows = enrich(valid_messages(decoded(spark, [json.dumps(FULL)])), dim=8)
        append_postings(rows.withColumn("posting_id", F.lit("own-id")), name, 3)
        stored = spark.table(name).first()
        assert stored.posting_id == "own-id" and stored.batch_id == 3 and stored.title == "Kỹ sư"
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_batches_replace_themselves_and_later_ones_win(spark, tmp_path):
    path = str(tmp_path / "postings")

    def rows(*titles):
        values = [json.dumps({"title": t, "link": f"http://h/{t[0]}"}) for t in titles]
        return enrich(valid_messages(decoded(spark, values)), dim=8)

    write_batch(rows("a1", "b1"), path, 0)
    write_batch(rows("a2"), path, 1)
    write_batch(rows("a2", "c1"), path, 1)
    assert read_batches(spark, path, POSTING).count() == 4
    assert sorted(r.title for r in read_postings(spark, path).collect()) == ["a2", "b1", "c1"]
    assert read_postings(spark, path, limit=2).count() == 2
    assert read_postings(spark, path, doc_type="cv").count() == 0


def test_compacted_postings_read_as_before(spark, tmp_path):
    path, compacted = str(tmp_path / "postings"), str(tmp_path / "compacted")

    def rows(*titles):
        values = [json.dumps({"title": t, "link": f"http://h/{t[0]}"}) for t in titles]
        return enrich(valid_messages(decoded(spark, values)), dim=8)

    def titles(**options):
        return sorted(r.title for r in read_postings(spark, path, **options).collect())

    write_batch(rows("a1", "b1", "c1"), path, 0)
    write_batch(rows("a2"), path, 1)
    assert compact_postings(spark, path, compacted, 2000) == 1
    assert titles(compacted=compacted) == titles() == ["a2", "b1", "c1"]
    write_batch(rows("b2", "d1"), path, 2)
    write_batch(rows("b3"), path, 3)
    assert titles(compacted=compacted) == titles() == ["a2", "b3", "c1", "d1"]
    assert compact_postings(spark, path, compacted, 2000) == compact_postings(spark, path, compacted, 2000) == 3
    assert titles(compacted=compacted) == ["a2", "b3", "c1", "d1"]
    plan = read_postings(spark, path, compacted=compacted)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_compaction_rewrites_touched_buckets_and_survives_a_crash(spark, tmp_path, monkeypatch):
    path, compacted = str(tmp_path / "postings"), str(tmp_path / "compacted")

    def rows(*titles):
        values = [json.dumps({"title": t, "link": f"http://h/{t.split('-')[0]}"}) for t in titles]
        return enrich(valid_messages(decoded(spark, values)), dim=8)

    def titles():
        return sorted(r.title for r in read_postings(spark, path, compacted=compacted).collect())

    names = [f"p{k}" for k in range(40)]
    write_batch(rows(*[f"{n}-0" for n in names]), path, 0)
    compact_postings(spark, path, compacted, 3000)
    (first,) = compaction.manifests(spark, compacted)
    assert first.buckets > 4 and first.through == 0
    pinned = compaction.read_buckets(spark, compacted, first)
    write_batch(rows("p7-1", "new-1"), path, 1)
    write = compaction.write_manifest

    def crash(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(compaction, "write_manifest", crash)
    with pytest.raises(RuntimeError):
        compact_postings(spark, path, compacted, 3000)
    monkeypatch.setattr(compaction, "write_manifest", write)
    expected = sorted([f"{n}-0" for n in names if n != "p7"] + ["p7-1", "new-1"])
    assert len(compaction.manifests(spark, compacted)) == 1 and titles() == expected
    assert compact_postings(spark, path, compacted, 3000) == 1
    second = compaction.manifests(spark, compacted)[-1]
    rewritten = [b for b, v in second.folders.items() if v == second.version]
    assert 1 <= len(rewritten) <= 2 < len(second.folders) and titles() == expected
    # Who reads the first manifest still can, until its folders are removed.
    assert sorted(r.title for r in pinned.collect()) == sorted(f"{n}-0" for n in names)
    assert compaction.removable(spark, path, compacted, keep=2) == [f"{path}/batch_id=0"]
    compaction.remove(spark, compaction.removable(spark, path, compacted))
    assert titles() == expected and len(compaction.manifests(spark, compacted)) == 1
    assert sorted(p.name for p in (tmp_path / "postings").iterdir() if p.name.startswith("batch")) == []
    # Many more rows: smaller buckets, all written anew.
    write_batch(rows(*[f"q{k}-2" for k in range(400)]), path, 2)
    compact_postings(spark, path, compacted, 1000)
    third = compaction.manifests(spark, compacted)[-1]
    assert third.buckets > second.buckets and set(third.folders.values()) == {third.version}
    assert titles() == sorted(expected + [f"q{k}-2" for k in range(400)])
    with pytest.raises(ValueError):
        read_postings(spark, path, compacted=str(tmp_path / "none"))


def test_latest_keeps_everything_else(spark):
    frame = spark.createDataFrame([("a", 0), ("a", 0), ("a", 2), ("b", 1)], "posting_id string, batch_id long")
    assert sorted(map(tuple, latest(frame).collect())) == [("a", 2), ("b", 1)]


@pytest.fixture
def stream_paths(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    return source, *(str(tmp_path / name) for name in ("postings", "rejects", "checkpoint"))


def run_stream(spark, stream_paths, **options):
    source, postings, rejects, checkpoint = stream_paths
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    query = start_ingest(stream, postings, rejects, checkpoint, ["value"], dim=8, **options)
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_restarts_cleanly(spark, stream_paths):
    source, postings, rejects, _ = stream_paths
    lines = [json.dumps(FULL | {"link": f"http://h/{i}", "title": f"t{i}"}) for i in range(12)]
    (source / "a.txt").write_text("\n".join([*lines[:5], "{bad", ""]) + "\n", encoding="utf-8")
    (source / "b.txt").write_text("\n".join(lines[5:]) + "\n", encoding="utf-8")
    query = run_stream(spark, stream_paths)
    metrics = [p.observedMetrics["messages"] for p in query.recentProgress if "messages" in p.observedMetrics]
    assert sum(m.received for m in metrics) == 14 and sum(m.empty for m in metrics) == 1
    columns = [c for c in POSTING.names if c != "metadata"]
    stored = sorted(map(str, read_postings(spark, postings).select(*columns).collect()))
    batch = enrich(valid_messages(decoded(spark, lines)), dim=8).select(*columns)
    assert stored == sorted(map(str, batch.collect()))
    assert [r.reason for r in read_rejects(spark, rejects).collect()] == ["not JSON"]
    run_stream(spark, stream_paths)
    assert read_batches(spark, postings, POSTING).count() == 12
    (source / "c.txt").write_text(json.dumps(FULL | {"link": "http://h/0", "title": "again"}), encoding="utf-8")
    run_stream(spark, stream_paths)
    titles = {r.title for r in read_postings(spark, postings).collect()}
    assert "again" in titles and "t0" not in titles and len(titles) == 12
    status = batch_status(read_batches(spark, postings, POSTING), read_rejects(spark, rejects))
    assert sorted((r.saved, r.rejected) for r in status.collect()) == [(1, 0), (5, 1), (7, 0)]


def test_spread_stream(spark, stream_paths):
    source, postings, *_ = stream_paths
    lines = [json.dumps(FULL | {"link": f"http://h/{i}"}) for i in range(30)]
    (source / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    run_stream(spark, stream_paths, tasks=6)
    assert read_postings(spark, postings).count() == 30


def test_topic_needs_the_connector(spark):
    with pytest.raises(Exception, match="kafka"):
        read_topic(spark, "localhost:9092", "postings", per_batch=5)
    with pytest.raises(Exception, match="kafka"):
        write_topic(spark.range(1), "localhost:9092", "postings")


def test_document_form(spark):
    rows = enrich(valid_messages(decoded(spark, [json.dumps(FULL)])), dim=4)
    (row,) = to_documents(rows).collect()
    document = json.loads(row.document)
    assert list(document) == [name for name in POSTING.names if name != "posting_id"]
    assert document["skills_signature"][0].startswith("hash_") and len(document["skills_signature"]) == 128
    assert document["metadata"]["source"] == "job_description"
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", document["metadata"]["indexed_at"])


def test_failed_batch_is_written_once_after_restart(spark, stream_paths):
    source, postings, *_ = stream_paths
    (source / "a.txt").write_text(json.dumps(FULL), encoding="utf-8")

    def broken():
        raise RuntimeError("model is down")

    with pytest.raises(Exception, match="model is down"):
        run_stream(spark, stream_paths, embedder=broken)
    store = VectorStore(str(source.parent / "vectors"), "ones")
    run_stream(spark, stream_paths, embedder=lambda: lambda texts: [[1.0] for _ in texts], store=store)
    assert store.read(spark).count() == 2
    assert [r.description_vector for r in read_postings(spark, postings).collect()] == [[1.0]]


def asked_texts(log):
    return sorted(line for name in os.listdir(log) for line in open(f"{log}/{name}").read().split("\n"))


def test_vectors_are_kept_across_batches(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    store = VectorStore(str(tmp_path / "vectors"), "lengths")

    def batch(number, *texts, **options):
        messages = spark.createDataFrame([(json.dumps({"link": f"http://h/{number}-{k}", "description": t}),) for k, t in enumerate(texts)], "value string")
        paths = str(tmp_path / "p"), str(tmp_path / "r")
        store_batch(messages, *paths, number, ["value"], counting_model(str(log)), 2, store=store, **options)
        return asked_texts(log)

    assert batch(0, "one", "two", "one") == ["one", "two"]
    assert batch(1, "two", "one") == ["one", "two"]
    # A text that the model fails on is not kept, nor is its zero vector.
    assert batch(2, "two", "poison", on_error="zero") == ["one", "two"]
    assert batch(3, "three", "poison", on_error="reject") == ["one", "three", "two"]
    assert {r.text_key for r in store.read(spark).collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in ("one", "two", "three")}
    vectors = {r.description: r.description_vector for r in read_postings(spark, str(tmp_path / "p")).collect()}
    assert vectors == {"one": [3.0, 1.0], "two": [3.0, 1.0], "three": [5.0, 1.0], "poison": [0.0, 0.0]}
    assert VectorStore(store.path, "other").read(spark).count() == 0
    # Equal rows of two jobs count once; a part that was not committed does not count.
    store.add(store.read(spark), "again")
    (tmp_path / "vectors" / "lengths" / "again" / "_SUCCESS").unlink()
    assert store.read(spark).count() == 3
    store.add(store.read(spark), "again")
    keys = store.read(spark).select("text_key").distinct()
    assert store.read(spark).count() == 6 and store.known(keys).count() == 3
    old = store.compact(spark, "whole", 1)
    assert len(old) == 3 and store.known(keys).count() == 3
    with pytest.raises(ValueError):
        VectorStore(store.path, "../x").read(spark)


def test_status_accounts_for_every_message(spark, stream_paths, tmp_path):
    source, *_ = stream_paths
    status = str(tmp_path / "status")
    lines = [json.dumps(FULL | {"link": f"http://h/{i % 4}", "title": f"t{i}"}) for i in range(6)]
    listener = BatchListener(spark, status)
    spark.streams.addListener(listener)
    try:
        (source / "a.txt").write_text("\n".join([*lines, "{bad", "", ""]) + "\n", encoding="utf-8")
        (source / "b.txt").write_text("[]\n", encoding="utf-8")
        listener.wait(str(run_stream(spark, stream_paths, status_path=status).runId))
        (source / "c.txt").write_text(lines[0], encoding="utf-8")
        listener.wait(str(run_stream(spark, stream_paths, status_path=status).runId))
    finally:
        spark.streams.removeListener(listener)
    rows = sorted(tuple(r)[1:] for r in ingest_status(spark, status).collect())
    assert rows == [(1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 0, 0), (9, 2, 4, 1, 2, 0)]
    with pytest.raises(TimeoutError):
        listener.wait("no run", 0.1)


def test_bulk_sink_reports_what_is_refused(spark, tmp_path):
    store, path = tmp_path / "store", str(tmp_path / "report")
    store.mkdir()
    documents = spark.createDataFrame([(f"d{k}", f"text {k}") for k in range(50)], "id string, document string").repartition(3)

    def open_sink():
        def send(rows):
            if any(i == "d7" for i, _ in rows):
                raise OSError("connection lost")
            for i, document in rows:
                if not i.endswith("3"):
                    (store / i).write_text(document)
            return {i: "no threes" for i, _ in rows if i.endswith("3")}

        return send

    for _ in range(2):
        bulk_write(documents, open_sink, path, 4, chunk=1, pause=0)
    refused = {r.id: (r.document, r.reason) for r in bulk_refused(spark, path).collect()}
    assert refused == {f"d{k}": (f"text {k}", "no threes") for k in (3, 13, 23, 33, 43)} | {"d7": ("text 7", "store: connection lost")}
    assert [tuple(r) for r in bulk_status(spark, path).collect()] == [(4, 44, 6)]
    assert len(list(store.iterdir())) == 44
    # A report that was not committed does not count.
    (tmp_path / "report" / "batch_id=4" / "_committed.json").unlink()
    assert bulk_refused(spark, path).count() == bulk_status(spark, path).count() == 0
    bulk_write(documents.limit(0), open_sink, path, 5)
    assert [tuple(r) for r in bulk_status(spark, path).collect()] == [(5, 0, 0)]


def test_a_chunk_is_tried_again_before_it_is_refused():
    calls = []

    def sink(rows):
        calls.append(len(rows))
        if len(calls) < 3:
            raise OSError("busy")

    writer = BulkWriter(lambda: sink, "", 10, 3, 0)
    assert writer.send(sink, [("a", "x"), ("b", "y")]) == {} and calls == [2, 2, 2]
    calls.clear()
    assert BulkWriter(lambda: sink, "", 10, 2, 0).send(sink, [("a", "x")]) == {"a": "store: busy"}


def test_a_compaction_moves_rows_once(spark, tmp_path, monkeypatch):
    path, compacted = str(tmp_path / "postings"), str(tmp_path / "compacted")

    def add(batch, *rows):
        frame = spark.createDataFrame(rows, "posting_id string, title string")
        columns = [F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in POSTING]
        write_batch(frame.select(columns), path, batch)

    # Rows without an id and equal rows of one batch all stay.
    add(0, ("a", "a0"), ("b", "b0"), ("c", "c0"), (None, "n0"))
    add(1, ("a", "a1"), ("a", "a1"), (None, "n1"))
    compact_postings(spark, path, compacted, 1 << 20)
    add(2, ("b", "b2"), ("d", "d2"), (None, "n2"))
    add(3, ("d", "d3"))
    joins = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "join", lambda self, *a, plain=frame.join, **k: joins.append(a) or plain(self, *a, **k))
    compact_postings(spark, path, compacted, 1 << 20)
    assert not joins
    rows, through = compaction.read_compacted(spark, compacted)
    assert through == 3
    assert sorted(r.title for r in rows.collect()) == ["a1", "a1", "b2", "c0", "d3", "n0", "n1", "n2"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_decoded_from_kept_messages(spark, tmp_path, monkeypatch):
    """Not from a cache of decoded rows, which take many times as much memory and disk."""
    cached = []
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda self, *a: cached.append(self) or self)
    bodies = [{"title": f"t{i}", "description": "d", "link": f"http://h/{i % 8}"} for i in range(10)]
    values = [json.dumps(b) for b in bodies] + ["{", "", None]
    messages = spark.createDataFrame(list(enumerate(values)), "offset int, value string")
    paths = str(tmp_path / "p"), str(tmp_path / "r")
    store_batch(messages, *paths, 0, ["offset"], dim=2, tasks=3, status_path=str(tmp_path / "s"))
    assert not cached
    assert sorted(r.title for r in read_postings(spark, paths[0]).collect()) == [f"t{i}" for i in range(2, 10)]
    assert [r.reason for r in read_rejects(spark, paths[1]).collect()] == ["not JSON"]
    stored = read_batches(spark, str(tmp_path / "s" / "stored"), spark.createDataFrame([(1, 1, 1)], "saved long, rejected long, replaced long").schema)
    assert [tuple(r)[:3] for r in stored.collect()] == [(8, 1, 2)]
    assert not [name for name in os.listdir(paths[1]) if name.startswith("_messages")]


def test_messages_of_single_ids_are_not_moved(spark, monkeypatch):
    def last(ids):
        values = [json.dumps({"title": f"t{i}", "link": f"http://h/{k}"}) for i, k in enumerate(ids)]
        frame = spark.createDataFrame(list(enumerate(values)), "offset int, value string")
        return last_per_posting(valid_messages(decode_messages(frame)), ["offset"])

    assert "Exchange" not in plan_of(last([1, 2, 3])) and last([1, 2, 3]).count() == 3
    assert sorted(r.title for r in last([1, 2, 1, 3]).collect()) == ["t1", "t2", "t3"]
    monkeypatch.setattr(messages_module, "SENT_BYTES", 0)
    assert sorted(r.title for r in last([1, 2, 1, 3]).collect()) == ["t1", "t2", "t3"]


def test_outdated_rows_are_left_out_where_they_lie(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    rows = [("a", 0, "x"), ("a", 0, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 0, "n"), (None, 1, "m"), ("c", None, "o")]
    spark.createDataFrame(rows, "posting_id string, batch_id long, text string").write.parquet(path)
    expected = ["m", "n", "o", "y", "z"]

    def kept():
        return sorted(r.text for r in latest(spark.read.parquet(path)).collect())

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(latest(spark.read.parquet(path)))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
        assert "Join" not in plan_of(latest(spark.read.parquet(path).filter("batch_id = 1")))
        assert kept() == expected
        # Other ids with the hash of an outdated one, and more keys than are sent.
        with monkeypatch.context() as all_alike:
            all_alike.setattr(batches.F, "xxhash64", lambda *columns: F.lit(1).cast("long"))
            assert kept() == expected
        monkeypatch.setattr(batches, "SENT_BYTES", 0)
        assert kept() == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_compaction_leaves_old_rows_in_their_buckets(spark, tmp_path, monkeypatch):
    path, compacted = str(tmp_path / "postings"), str(tmp_path / "compacted")

    def add(batch, *rows):
        frame = spark.createDataFrame(rows, "posting_id string, title string")
        columns = [F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in POSTING]
        write_batch(frame.select(columns).coalesce(1), path, batch)
        compact_postings(spark, path, compacted, 1 << 20)
        (bucket,) = compaction.manifests(spark, compacted)[-1].folders.items()
        assert sorted(r.title for r in compaction.read_compacted(spark, compacted)[0].collect()) == sorted(expected)
        return compaction.files(spark, f"{compacted}/data/version={bucket[1]}/bucket={bucket[0]}")

    expected = ["a0", "b0", "n0"]
    assert add(0, ("a", "a0"), ("b", "b0"), (None, "n0")) == 1
    expected = ["a0", "b1", "c1", "n0", "n1"]
    assert add(1, ("b", "b1"), ("c", "c1"), (None, "n1")) == 2
    # A bucket of many files becomes one file.
    monkeypatch.setattr(compaction, "FILES", 2)
    expected = ["a2", "b1", "c1", "n0", "n1"]
    assert add(2, ("a", "a2")) == 1
    # Hashes that do not tell ids apart, and more of them than are sent.
    expected = ["a2", "b1", "c3", "n0", "n1"]
    with monkeypatch.context() as all_alike:
        all_alike.setattr(compaction.F, "xxhash64", lambda *columns: F.lit(1).cast("long"))
        assert add(3, ("c", "c3")) == 1
    monkeypatch.setattr(compaction, "SENT_BYTES", 0)
    expected = ["a2", "b1", "c3", "d4", "n0", "n1"]
    assert add(4, ("d", "d4")) == 1


def test_batches_are_taken_from_written_ones(spark, tmp_path, monkeypatch):
    """Rows that several batches have are enriched once, and no other copy of them is written."""
    import table_queries

    texts = [(i, f"word{i} of {i % 3}\nline {i}", "en", "web", 20) for i in range(24)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(table_queries, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    path, index = table_queries._indexed(spark, str(tmp_path))
    assert sorted(os.listdir(tmp_path / "indexed")) == ["index", "postings"]
    stored = read_batches(spark, path, POSTING).withColumn("number", table_queries._number()).collect()
    titles = dict((i, text) for i, text, *_ in texts)
    assert {(r.number, r.title) for r in stored if r.batch_id == 1} == {(i, titles[i]) for i in range(24) if i % 6 != 4}
    assert {(r.number, r.title) for r in stored if r.batch_id == 0} == {(i, titles[i] if i % 6 == 4 else "older words") for i in range(24) if i % 3}
    found = {(r.title, r.doc_type) for r in table_queries.q_compacted_postings(spark, str(tmp_path)).collect()}
    assert sorted(os.listdir(tmp_path / "compacted")) == ["batches", "current"]
    later = {i for i in range(24) if i % 2 == 1 or i % 6 == 0}
    jobs = {(titles[i], "job") for i in later if i % 3 == 0} | {("again" if i % 4 == 0 else titles[i], "job") for i in range(0, 24, 2) if i not in later}
    assert found == jobs
