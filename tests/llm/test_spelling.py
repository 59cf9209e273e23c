"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairwell.llm import spelling
from pairwell.llm.spelling import grouped, near_pairs, spelling_variants, vocabulary

SCHEMA = "doc_id long, text string"


def counted(rows, least=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows):
    words = counted(rows)
    out, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = [len(close), words[form[w]] if form[w] else None]
    result = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, words[w], *out[w]))
    return result


def variant(rng, word):
    k, letter = rng.randrange(len(word) + 1), rng.choice("abé÷Àz")
    return rng.choice([word[:k] + letter + word[k:], word[: max(k - 1, 0)] + word[k:], word[: max(k - 1, 0)] + letter + word[k:]])


def corpus(seed):
    rng = random.Random(seed)
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "Ähnlich", "ähnlich", "straße", "×÷ÀÿÉé", "abcabcabc"]
    words += ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(30)]
    for _ in range(60):
        words.append(variant(rng, rng.choice(words)))
    weights = [rng.choice([1, 3, 20, 130]) for _ in words]
    rows = [
        (doc, "".join(rng.choice([w, w.upper()]) + rng.choice([" ", "-", "5", "Ā", "\n", "ß "]) for w in rng.choices(words, weights, k=200)))
        for doc in range(60)
    ]
    return rows + [(None, "abcabcabc abcabcabc"), (70, None), (71, ""), (5, rows[5][1]), (72, "…12 ·")]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "BLOCK", 4000)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in spelling_variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 3)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in spelling_variants(docs).collect()} == brute(rows)
    words = spark.createDataFrame([("x" * 20 + chr(97 + a) + chr(97 + b) + "y" * 20, 9) for a in range(9) for b in range(9)], "word string, n long")
    sizes = grouped(words).groupBy("key", "lo", "hi").count().filter("hi - lo > 1").agg({"count": "max"}).first()[0]
    assert sizes is None or sizes <= 3


def test_scan_in_small_steps(monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7]))) for _ in range(120)})
    m, zero = np.full(len(words), 6), np.zeros(len(words), np.int64)
    expected = {(a, b) for a in range(len(words)) for b in range(len(words)) if near(words[a], words[b]) and min(len(words[a]), len(words[b])) == 6}
    for states in (1, 7, 1 << 20):
        monkeypatch.setattr(spelling, "STATES", states)
        q, w = near_pairs(pa.array(words, pa.large_string()), zero, m, zero, m + 1)
        assert len(q) == len(expected) and set(zip(q.tolist(), w.tolist())) == expected


def test_hashes_of_short_and_long_runs(spark):
    runs = ["letter", "b" * 63, "c" * 64, "d" * 65, "é" * 40, "e" * 500]
    rows = [(doc, " ".join(runs)) for doc in range(400)]
    got = {r.word: r.n for r in vocabulary(spark.createDataFrame(rows, SCHEMA), least=1).collect()}
    assert got == counted(rows, least=1) and len(got) > len(runs)


def test_long_words(spark):
    word = "ab" * 3000
    rows = [(k, " ".join([word] * 30 + [word + "x"] * 5 + ["y" + word[1:]] * 5)) for k in range(1)]
    assert {tuple(r) for r in spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, "spelling " * 30 + "speling " * 5, "w", 1, "f", 2)]
    docs = spark.createDataFrame(rows, SCHEMA + ", word string, n int, form string, m int")
    assert {tuple(r) for r in spelling_variants(docs).collect()} == brute([r[:2] for r in rows])
    assert spelling_variants(docs.limit(0)).count() == 0
