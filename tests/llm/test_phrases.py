"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pairwell.llm import phrases
from pairwell.llm.phrases import collocations, packed, phrase_counts, summed, unpacked, words_of

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows):
    grams, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                grams[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return grams, totals


def brute(rows, best):
    grams, totals = counted(rows)
    out = []
    for lang, f in grams.items():
        known = {g: a for g, a in f.items() if len(g) > 1 and a >= phrases.LEAST}
        scored = []
        for g, a in known.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in known.items()):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), " ".join(g), a, f[g[:k]], f[g[k:]], score))
        for rank, (_, _, _, name, a, l, r, score) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, name, a, l, r, totals[lang], score))
    return sorted(out)


def corpus(seed, docs=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "Été", "x y", "a-b", "—", "über", "z"]
    fixed = ["New York City hall", "of the of the", "a a a a a", "Été — über z"]
    rows = []
    for k in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n", "?!"]) for p in parts)
        rows.append((k, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(100, None, "en"), (101, "", None), (102, " \t.\n", "fr"), (0, rows[0][1], rows[0][2])]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_phrases(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "BLOCK", 700 + 300 * seed)
    monkeypatch.setattr(phrases, "WINDOW_BLOCK", 500 + 400 * seed)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, best=12).collect())
    assert got == brute(rows, 12)


def test_counts_stay_exact_where_hashes_collide(spark, monkeypatch):
    rows = corpus(9, 80)
    grams, totals = counted(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = {(lang, len(g), " ".join(g), a) for lang, f in grams.items() for g, a in f.items() if a >= phrases.LEAST}
    expected |= {(lang, 0, "", n) for lang, n in totals.items() if n}
    usual = {tuple(r) for r in phrase_counts(docs).collect()}
    monkeypatch.setattr(phrases.Bitmap, "may_hold", lambda self, hashes: np.ones(len(hashes), bool))
    assert usual == expected == {tuple(r) for r in phrase_counts(docs).collect()}


def test_rare_words_leave_no_windows(spark):
    text = " ".join(f"word{k}" for k in range(3000)) + " common pair" * 40
    docs = spark.createDataFrame([(1, text, "en")], SCHEMA)
    narrow = docs.select("text", "lang")
    known = [phrases.bitmap(phrases.frequent_hashes(narrow))]
    known.append(phrases.bitmap(phrases.frequent_hashes(narrow, *known)))
    rows = phrases.windows(narrow, *known).collect()
    assert sum(r.n for r in rows) == 3080 and len(rows) < 20


def test_windows_end_where_a_longer_beginning_is_rare(spark):
    """Every pair of three words is frequent, but few of their sequences of three and four are."""
    rng = random.Random(4)
    text = " ".join(rng.choice("abc") for _ in range(600)) + "." + " ".join(["a b c a"] * 40)
    docs = spark.createDataFrame([(1, text, "en")], SCHEMA)
    narrow = docs.select("text", "lang")
    known = [phrases.bitmap(phrases.frequent_hashes(narrow))]
    wide = phrases.windows(narrow, *known).select("w1", "w2", "w3", "w4").distinct().count()
    known.append(phrases.bitmap(phrases.frequent_hashes(narrow, *known)))
    assert phrases.windows(narrow, *known).select("w1", "w2", "w3", "w4").distinct().count() < wide / 2
    rows = [(1, text, "en")]
    assert sorted(tuple(r) for r in collocations(docs).collect()) == brute(rows, 2000)


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << phrases.HASH_BITS, 5000, dtype=np.uint64))
    counts = rng.integers(1, 90, len(values))
    a, b = unpacked(packed(values, counts))
    assert (a == values).all() and (b == np.minimum(counts, phrases.LEAST)).all()
    c, d = summed([(a, b), (a[::2], b[::2])])
    assert (c == values).all() and (d == np.minimum(np.where(np.arange(len(b)) % 2 == 0, 2, 1) * b.astype(int), phrases.LEAST)).all()
    assert len(unpacked(packed(values[:0], counts[:0]))[0]) == 0


def test_words_of_a_block():
    found = words_of(pa.array(["One two", None, "two. THREE\tfour"]), pa.array(["en", "en", None]))
    assert found.words.take(pa.array(found.ids)).to_pylist() == ["one", "two", "two", "three", "four"]
    assert found.langs(found.ids).to_pylist() == ["en", "en", "und", "und", "und"]
    assert found.joined.tolist() == [True, False, False, True, False]


def test_large_counts_are_exact():
    a, parts = 9_000_000_000_001, 17_000_000_000_003
    assert phrases.SCALE * a > 1 << 63  # why the score is computed in decimals
    assert phrases.SCALE * a // parts == 1058823


def test_clashing_columns_and_empty_table(spark):
    schema = SCHEMA + ", phrase string, n int, f int, words int, size int, w1 string"
    rows = [(k, "left right", "en", "p", 1, 2, 3, 4, "w") for k in range(30)]
    docs = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in collocations(docs).collect()] == [("en", 1, "left right", 30, 30, 30, 60, 1000000)]
    assert collocations(docs.limit(0)).count() == 0
