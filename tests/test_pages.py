from pyspark.sql import functions as F

import time

import pyarrow as pa
import pytest

from pairwell.functions import page_tree
from pairwell.operators.documents import convert_documents
from pairwell.operators.frontier import discover_links, distinct_links, merged_history, unseen
from pairwell.operators.pages import extract_page_fields, list_page_urls
from pairwell.sources.files import read_documents, write_json, write_rejects, write_texts
from pairwell.sources.history import append_history, read_history
from pairwell.streaming.links import new_links, new_links_for, without_empty_batches

LIST_PAGE = (
    '<div class="block-job-list"><a href="http://h/dev-1-jv?s=1">1</a><a href="http://h/dev-1-jv/#top">again</a>'
    '<a href="http://h/nha-tuyen-dung/x-jv">company</a><a href="http://h/about">about</a><a href="">none</a></div>'
    '<footer><a href="http://h/ad-9-jv">ad</a></footer>'
)


@pytest.fixture
def pages(spark):
    rows = [(1, LIST_PAGE), (2, LIST_PAGE.replace("dev-1", "dev-2")), (3, LIST_PAGE), (4, None)]
    return spark.createDataFrame(rows, "page_id int, html string")


def test_discover_links(pages):
    rows = discover_links(pages, scope=None).filter("page_id = 1").orderBy("position").collect()
    assert [(r.position, r.url_key) for r in rows] == [(0, "http://h/dev-1-jv"), (1, "http://h/dev-1-jv"), (5, "http://h/ad-9-jv")]
    scoped = discover_links(pages)
    assert scoped.select("url_key").distinct().count() == 2


def test_distinct_links_keep_the_first(pages):
    rows = {r.url_key: (r.page_id, r.position, r.url) for r in distinct_links(discover_links(pages, scope=None)).collect()}
    assert rows["http://h/dev-1-jv"] == (1, 0, "http://h/dev-1-jv?s=1")
    assert rows["http://h/dev-2-jv"][0] == 2 and len(rows) == 3


def test_history_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "links")
    seen = spark.createDataFrame([("http://h/dev-1-jv/?old=1",)] * 50, "url string")
    append_history(seen, path)
    (tmp_path / "links" / "more.csv").write_text("\n\nhttp://h/other\n")
    history = read_history(spark, path)
    assert history.count() == 51
    fresh = unseen(discover_links(pages, scope=None), history)
    assert {r.url_key for r in fresh.collect()} == {"http://h/dev-2-jv", "http://h/ad-9-jv"}
    assert merged_history(history, fresh).count() == 4
    append_history(fresh, path)
    assert unseen(discover_links(pages, scope=None), read_history(spark, path)).count() == 0


def test_link_stream_survives_restart(spark, pages, tmp_path):
    source, sink, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    history = spark.createDataFrame([("http://h/ad-9-jv",)], "url string")

    def run():
        stream = spark.readStream.schema("page_id int, html string").parquet(source)
        fresh = new_links(discover_links(stream, scope=None), history).select("url_key")
        writer = fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.url_key for r in spark.read.schema("url_key string").parquet(sink).collect())

    pages.filter("page_id = 1").coalesce(1).write.mode("append").parquet(source)
    assert run() == ["http://h/dev-1-jv"]
    pages.filter("page_id > 1").coalesce(1).write.mode("append").parquet(source)
    assert run() == ["http://h/dev-1-jv", "http://h/dev-2-jv"]
    assert run() == ["http://h/dev-1-jv", "http://h/dev-2-jv"]


def test_link_stream_with_bounded_state(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "url_key string, at string").withColumn("at", F.to_timestamp("at"))
    frame.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    writer = new_links(stream, time="at").writeStream.format("parquet").option("path", sink)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.url_key for r in spark.read.schema(frame.schema).parquet(sink).collect()) == ["a", "b"]


def test_links_that_the_state_forgets(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    schema = "page_id int, position int, url string, url_key string"

    def run(rows, ttl):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        history = spark.createDataFrame([("old",)], "url string")
        writer = new_links_for(stream, ttl, history).writeStream.format("parquet").option("path", sink)
        with without_empty_batches(spark):
            query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        found = sorted((r.url_key, r.page_id, r.position) for r in spark.read.schema(schema).parquet(sink).collect())
        return found, query.lastProgress.stateOperators[0].numRowsTotal

    first = [(2, 0, "a?1", "a"), (1, 5, "a", "a"), (1, 7, "a", "a"), (1, 0, "old", "old"), (3, 1, "b", "b")]
    assert run(first, 15_000) == ([("a", 1, 5), ("b", 3, 1)], 2)
    # Another run of the same query knows them still, and then no longer.
    assert run([(4, 0, "a", "a"), (4, 1, "c", "c")], 15_000) == ([("a", 1, 5), ("b", 3, 1), ("c", 4, 1)], 3)
    time.sleep(16)
    found, rows = run([(5, 0, "a", "a")], 15_000)
    assert found == [("a", 1, 5), ("a", 5, 0), ("b", 3, 1), ("c", 4, 1)] and rows <= 3


def test_list_page_urls(spark):
    totals = spark.createDataFrame([("x", "101"), ("y", "?"), ("z", "0")], "site string, total string")
    rows = list_page_urls(totals, "total", "http://h/jobs?page={page}").orderBy("site", "page").collect()
    assert [(r.site, r.page_url) for r in rows] == [
        ("x", "http://h/jobs?page=1"),
        ("x", "http://h/jobs?page=2"),
        ("x", "http://h/jobs?page=3"),
        ("y", "http://h/jobs?page=1"),
    ]


def test_posting_page(spark):
    html = (
        '<h1 name="title">Kỹ sư dữ liệu</h1><a>Nộp đơn</a><div>1</div><div>2</div><div>3</div><div>4</div>'
        "<div>Mô tả<br>dài</div><h2>Địa điểm làm việc</h2><div>1</div><div>2</div><div>Hà Nội</div>"
        "<span>KỸ NĂNG</span><p>SQL, Spark</p><span>SỐ NĂM KINH NGHIỆM TỐI THIỂU</span><p>3</p>"
        "<h2>Yêu cầu công việc</h2><div>Ba năm</div>"
    )
    rows = spark.createDataFrame([("u1", html), ("u2", "<p>"), ("u3", None)], "url string, html string")
    got = {r.link: r for r in extract_page_fields(rows).collect()}
    assert got["u1"].asDict() == {
        "title": "Kỹ sư dữ liệu",
        "location": "Hà Nội",
        "description": "Mô tả\ndài",
        "required_skills": "SQL, Spark",
        "min_experience_years": "3",
        "job_requirements": "Ba năm",
        "link": "u1",
    }
    assert got["u2"].title == "" and got["u2"].min_experience_years == "0" and "u3" not in got


def test_documents(spark, tmp_path):
    (tmp_path / "a.v1.PDF").write_bytes(b"%PDF one")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"bad")
    files = read_documents(spark, str(tmp_path))
    assert files.count() == 2

    def converter():
        def to_text(content):
            if not content.startswith(b"%PDF"):
                raise ValueError("no header")
            return content.decode()[5:]

        return to_text

    kept = {r.stem: (r.text, r.error) for r in convert_documents(files, converter, on_error="keep").collect()}
    assert kept == {"a": ("one", None), "c": (None, "no header")}
    with pytest.raises(Exception, match="no header"):
        convert_documents(files, converter).collect()
    with pytest.raises(ValueError):
        convert_documents(files, on_error="skip")
    converted = convert_documents(files, converter, on_error="keep")
    write_texts(converted, str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).count() == 2
    write_rejects(converted.filter("error is not null").select("path", "error"), str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1


def test_html_and_text_documents(spark):
    rows = [("x/p.html", "<p>Xin chào</p><p>b</p>".encode()), ("x/t.md", "# chào <b>".encode())]
    files = spark.createDataFrame(rows, "path string, content binary")
    assert {r.stem: r.text for r in convert_documents(files).collect()} == {"p": "Xin chào\nb", "t": "# chào <b>"}


class Batch:
    """An Arrow batch that gives no more than some texts at a time to Python."""

    def __init__(self, texts):
        self.texts = texts

    def __len__(self):
        return len(self.texts)

    def slice(self, *at):
        return Batch(self.texts.slice(*at))

    def to_pylist(self):
        assert len(self.texts) <= page_tree.TEXTS_AT_A_TIME
        return self.texts.to_pylist()


def test_references_of_a_large_batch_are_decoded_some_at_a_time():
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"{i} &lt; &amp;amp;" for i in range(2 * page_tree.TEXTS_AT_A_TIME + 1)]
    for length in (0, 1, page_tree.TEXTS_AT_A_TIME, len(texts)):
        plain = [t and t.replace("&lt;", "<").replace("&amp;amp;", "&amp;") for t in texts[:length]]
        assert page_tree.unescaped(Batch(pa.array(texts[:length], pa.string()))).to_pylist() == plain


def test_missing_document_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_documents(spark, str(tmp_path / "nothing")).count()


def test_json_keeps_other_scripts(spark, tmp_path):
    write_json(spark.createDataFrame([("Hà Nội",)], "a string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text(encoding="utf-8") == '{"a":"Hà Nội"}\n'
