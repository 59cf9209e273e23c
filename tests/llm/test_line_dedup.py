"""Line deduplication against a plain loop."""

import random

from pairwell.llm import line_dedup
from pairwell.llm.line_dedup import keep_bitmaps, streamed_firsts, with_kept_lines

SCHEMA = "doc_id long, text string"
SPACES = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    """(id, text) -> (lines, dropped, kept text); null ids are one document after all others."""
    order = lambda d: (d is None, d or 0)
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = key_of(line)
            first[key] = min(first.get(key, doc), doc, key=order)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key_of(x)) < 10 or first[key_of(x)] == doc]
        out[doc, text] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = with_kept_lines(docs, keep_bitmaps(docs)).collect()
    return {(r.doc_id, r.text): tuple(r.lines) for r in got}, got


ROWS = [
    (5, "A line that repeats\nshort\nown line of five"),
    (3, "\t a LINE that repeats \r\nshort\n\nshort"),
    (9, "own line of nine\na line that repeats\nÄ line that repeats\nä line that repeats"),
    (11, "ä line that repeats\na line that repeats"),
    (12, "a line that repeats\n"),
    (4, None), (6, ""), (7, "\n\n"), (8, " \t "),
    (13, "0123456789\n0123456789\n012345678"), (14, "0123456789\n012345678\n0123456789"),
    (15, "\u0085a line that repeats"), (16, " a line that repeats"),
    (None, "a line that repeats\nof no document"), (None, "of no document\nelse nothing"), (17, "of no document"),
    (18, "of row one\nof this document"), (18, "of this document\nof row two"), (18, "of this document\nof row two"),
]


def test_against_a_loop(spark):
    got, rows = run(spark, ROWS)
    assert got == brute(ROWS)
    assert len(rows) == len(ROWS)
    assert got[3, ROWS[1][1]][1] == 0 and got[12, ROWS[4][1]] == (2, 1, "")


def test_random_texts_with_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKETS", 16)
    monkeypatch.setattr(line_dedup, "OVERFULL", 1)
    monkeypatch.setattr(line_dedup, "OVERFULL_ROWS", 3)
    rng = random.Random(3)
    rows = []
    for doc in rng.sample(range(1000), 150):
        lines = [rng.choice([f"some line {rng.randrange(60)}", "the line of all documents", f"x{rng.randrange(3)}"]) for _ in range(rng.randrange(9))]
        rows.append((doc, "\n".join(lines)))
    assert run(spark, rows)[0] == brute(rows)


def test_long_text_of_alternating_runs(spark):
    lines = [f"line number {k}" for k in range(4000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines))]
    got, _ = run(spark, rows)
    assert got == brute(rows)
    assert got[2, rows[1][1]][1] == 2000


def test_bitmap_is_the_places_where_it_flips(spark):
    docs = spark.createDataFrame([(1, "aaaaaaaaaa\nbbbbbbbbbb\ncccccccccc"), (2, "aaaaaaaaaa\nbbbbbbbbbb\nx\ncccccccccc\ny")], SCHEMA)
    (row,) = keep_bitmaps(docs).collect()
    assert (row.doc, row.n_lines, row.n_dropped, row.keep) == (2, 5, 3, [0, 2, 3, 4])


def test_clashing_columns_and_empty_table(spark):
    schema = "doc_id long, text string, doc string, keep int, key string, line int, text_key int, n_lines int, row int, bucket int, salt int"
    rows = [(k, "the same long line\nown", "d", 1, "k", 2, 3, 4, 5, 6, 7) for k in (1, 2)]
    docs = spark.createDataFrame(rows, schema)
    got = with_kept_lines(docs, keep_bitmaps(docs)).orderBy("doc_id").collect()
    assert [r.lines.kept for r in got] == ["the same long line\nown", "own"] and got[0][:11] == rows[0]
    assert with_kept_lines(docs.limit(0), keep_bitmaps(docs.limit(0))).count() == 0
    again = with_kept_lines(docs, keep_bitmaps(docs), name="row").orderBy("doc_id").collect()
    assert [r.row.kept for r in again] == [r.lines.kept for r in got]


def test_rows_are_shuffled_once_and_stay_in_the_jvm(spark):
    lines = spark.range(100).selectExpr("id AS doc", "id AS text_key", "1 AS line", "id % 7 AS h1", "id % 5 AS h2")
    plan = streamed_firsts(lines, "h1", "h2")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    docs = spark.createDataFrame(ROWS, SCHEMA)
    whole = with_kept_lines(docs, keep_bitmaps(docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in whole for word in ("Python", "Pandas", "Arrow"))
