import random
import time
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwell.functions import cleaning, encode, markup, page_tree, scores, text
from pairwell.operators import hashing

X = F.col("x")


def test_strip_takes_every_unicode_space(values):
    assert values(text.strip(X), ["\u00a0 a\u3000b \n\x1f", "", None]) == ["a\u3000b", "", None]


def test_strip_on_many_strings(values):
    draw = random.Random(5)
    rows = ["".join(draw.choices(list("ab é\n\t\u00a0\u2003\u3000\x1c\u200b"), k=draw.randint(0, 8))) for _ in range(300)]
    assert values(text.strip(X), rows) == [row.strip() for row in rows]


def test_tokens(values):
    rows = ["Ab-çd É9, x_y  ", "### ___", None, "Node.js don't 3.14 1,000 a.b.c end. C++ x,y 2.x ’q", "nhân viên 日本 カナ"]
    assert values(text.tokens(X), rows) == [
        ["ab", "çd", "é9", "x_y"],
        [],
        None,
        ["node.js", "don't", "3.14", "1,000", "a.b.c", "end", "c", "x", "y", "2", "x", "q"],
        ["nhân", "viên", "日", "本", "カナ"],
    ]
    # Letters with separate marks stay whole.
    assert values(text.tokens(X), ["Kỹ sư."]) == [["kỹ", "sư"]]


def test_very_long_words(values):
    rows = ["1," * 20_000 + "1", "a." * 20_000, "x" * 50_000, "<a " * 20_000]
    sizes = [[len(word) for word in words[:2]] for words in values(text.tokens(X), rows)]
    assert sizes == [[40_001], [39_999], [50_000], [1, 1]]
    assert values(F.length(markup.inner_text(X)), rows)[2:] == [50_000, 59_999]
    assert values(F.size(page_tree.links(X)), rows) == [0] * 4


def test_normal_tokens(values):
    got = values(text.normal_tokens(X), [["Python", " ", "python\u00a0", "SQL"], []], "x array<string>")
    assert got == [["python", "sql"], []]


def test_clean_location(values):
    rows = ["Hà Nội\nHết hạn trong 5 ngày\n 120 lượt xem\n Quận 1 ", "A\n\nB", None, "hết hạn", ""]
    assert values(cleaning.clean_location(X), rows) == ["Hà Nội, Quận 1", "A, , B", "", "hết hạn", ""]


def test_clean_description(values):
    rows = ["Mô tả công việc:\n\n\nA\n\nB ", "MÔ TẢ CÔNG VIỆC:\u00a0\nA", "x mô tả công việc y", None]
    assert values(cleaning.clean_description(X), rows) == ["A\nB", "A", "x y", ""]


def test_clean_min_experience(values):
    rows = ["2-3 năm", "1.5", "Không yêu cầu", "", None, "0", "99999999999"]
    assert values(cleaning.clean_min_experience(X), rows) == [2, 1, 0, 0, 0, 0, 0]
    nothing = F.lit(None).cast("string")
    numbers = values(cleaning.clean_min_experience(nothing, X), [3.9, -2.0, 1.0, None], "x double")
    assert numbers == [3, -2, 1, 0]


def test_skills(values):
    assert values(cleaning.skill_list(X), ["Python, ,SQL", "", None]) == [["Python", "", "SQL"], [], []]
    assert values(cleaning.skills_text(cleaning.skill_list(X)), ["Python, ,SQL", ""]) == ["Python  SQL", ""]


def test_fill_experience(values):
    assert values(cleaning.fill_experience(X), ["", None, "a"]) == ["N/A", "N/A", "a"]


def test_first_non_blank(spark):
    row = spark.sql("select ' ' a, cast(null as string) b, 'x ' c")
    pick = cleaning.first_non_blank
    got = row.select(pick(F.col("a"), F.col("b"), F.col("c")), pick(F.col("a"), F.col("b"))).first()
    assert tuple(got) == ("x ", "")


def test_page_count(values):
    assert values(cleaning.page_count(X), ["1,234", "100", "0", "n/a", None, " 51 "]) == [25, 2, 0, 1, 1, 2]


def test_url_key(values):
    rows = ["http://h/a/1//?x=1#t", "http://h/a#t?x", "http://h/", "?x", None]
    assert values(encode.url_key(X), rows) == ["http://h/a/1", "http://h/a", "http://h", "", None]


def test_file_stem_and_stored_name(values):
    assert values(encode.file_stem(X), ["d/a.b.pdf", "a", "/x/y/.z"]) == ["a", "a", ""]
    first, again = values(encode.stored_name(X), ["d/a.pdf", "d/a.pdf"])
    assert first == again and first.endswith("_a.pdf")


def test_utc_iso_ignores_session_zone(spark):
    moment = datetime(2024, 1, 31, 8, 0, tzinfo=timezone.utc)
    frame = spark.createDataFrame([(moment,)], "x timestamp")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    try:
        assert frame.select(encode.utc_iso(X)).first()[0] == "2024-01-31T08:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hash_strings_and_zero_vector(values):
    assert values(encode.hash_strings(X), [[1, 4294967295]], "x array<bigint>") == [["hash_1", "hash_4294967295"]]
    assert values(encode.zero_vector(3), ["a"]) == [[0.0, 0.0, 0.0]]


def test_scores(spark):
    row = spark.sql("select array(1D, 0D) a, array(1D, 1D) b, array(1L, 2L) s, array(1L, 3L) t")
    a, b = F.col("a"), F.col("b")
    got = row.select(
        scores.cosine_plus_one(a, b),
        scores.sketch_jaccard(F.col("s"), F.col("t")),
        scores.rrf_term(F.lit(1.2), F.lit(1)) + scores.rrf_term(F.lit(1.5), F.lit(2)),
        scores.bm25_idf(F.lit(1), 3),
    ).first()
    assert got[0] == pytest.approx(1.7071067811865475)
    assert got[1] == 0.5
    assert got[2] == pytest.approx(0.043866, abs=1e-6)
    assert got[3] == pytest.approx(0.9808292530117262)


def test_inner_text_and_rules(values):
    html = (
        '<h1 name="title">A &amp; B</h1><script>x("</p>")</script><span> KỸ NĂNG </span><div><p>SQL,<br/>Spark</p>'
        "<p>no</p></div><b>Địa điểm làm việc</b><div>1</div><div>2</div><div>Hà Nội</div><!-- <p>z</p> -->"
    )
    rules = {"a": [page_tree.AfterLabel("KỸ NĂNG", "p")], "b": [page_tree.AfterLabel("Địa điểm làm việc", "div", 3)]}
    assert [tuple(r) for r in values(page_tree.field_texts(X, rules), [html])] == [("SQL,\nSpark", "Hà Nội")]
    assert values(markup.first_match(X, ["<h2>(.*?)</h2>", "(?s)<h1[^>]*>(.*?)</h1>"]), [html, "", None]) == [
        "A & B",
        "",
        "",
    ]


def test_links(values):
    html = '<a href="/x">1</a><A class="q" HREF="/y?z">2</A><area href="/no"><a name="n">3</a>'
    assert values(page_tree.links(X), [html]) == [["/x", "/y?z"]]
    html = """<a data-href="WRONG" href="right"><a href='x?a=1&amp;b=2'><a title='> href="no"' href=bare><a\nhref = "//o/p"><a href="">"""
    assert values(page_tree.links(X), [html, None, ""]) == [["right", "x?a=1&b=2", "bare", "//o/p", ""], None, []]
    resolved = page_tree.links(X, F.lit("https://h/list/1?p=2"))
    assert values(resolved, [html]) == [["https://h/list/right", "https://h/list/x?a=1&b=2", "https://h/list/bare", "https://o/p", ""]]


def test_fields_of_nested_and_open_elements(values):
    texts = lambda *rules: page_tree.field_texts(X, {"f": rules})
    after = page_tree.AfterLabel("Nơi", "div", 3)
    nested = "<b> Nơi\n</b><div>1</div><div>2</div><div>Ha Noi <div>Q1</div> tail</div><div>no</div>"
    assert values(texts(after), [nested]) == [("Ha Noi Q1\n tail",)]
    # Only an element that shows just the label counts, not its wrapper or a longer text.
    assert values(texts(page_tree.AfterLabel("Nơi", "p")), ["<p>Nơi ở</p><div><i>Nơi</i></div><p>L&#432;&#417;ng &eacute;</p>"]) == [("Lương é",)]
    path = page_tree.Path("c", [("div", None), ("div", 2)])
    assert values(texts(path, after), ['<p id="c"><div>x</div></p>', '<section id="c"><div><div>1</div><p>p</p><div>2</div></div></section>']) == [("",), ("2",)]
    heading = page_tree.UnderHeading("h2", "Yêu cầu", "div", "sc-6")
    page = '<div><h2>Yêu cầu công việc</h2><div class="q"><div class="a sc-6">Ba năm</div></div></div><div class="sc-6">no</div>'
    assert values(texts(path, heading), [page, None]) == [("Ba năm",), ("",)]


def test_open_elements_take_linear_time():
    start = time.process_time()
    for page in ("<div>" * 3000, "<p>" * 20_000, "<b>Nơi" + "<div>" * 3000, "<a href='" * 20_000):
        page_tree._first_text(page_tree.Tree(page), [page_tree.AfterLabel("Nơi", "div", 5)])
        page_tree.targets(page)
    assert time.process_time() - start < 10


def test_inside_of_an_element(values):
    page = '<div class="x">no</div><div class="list"><div>a</div>b</div><div class="list">c</div>'
    inside = page_tree.element_html(X, "div", "class", "list")
    assert values(inside, [page, "<p>", None, '<div class="list">open']) == ["<div>a</div>b", None, None, "open"]


def test_tokens_are_worked_on_some_lists_at_a_time():
    lists, seen = pa.array([["a"], None, ["b", "c"], [], ["d"]], pa.list_(pa.string())), []

    def lengths(part):
        seen.append(len(part))
        return part.value_lengths()

    assert hashing.some_at_a_time(lists, lengths, 2).to_pylist() == [1, None, 2, 0, 1] and seen == [2, 2, 1]
    assert hashing.some_at_a_time(lists.slice(0, 0), lengths, 2).to_pylist() == []
