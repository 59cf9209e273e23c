import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import pairwell.llm.ppm as ppm

TEXTS = ["abracadabra", "abcabd é", None, "", "xabx", "the cat the cat the hat", "a" * 40]


def counted(texts):
    counts = {}
    for text in texts:
        symbols = [ppm.START] * ppm.ORDER + list((text or "").encode()) + [ppm.END]
        for i in range(ppm.ORDER, len(symbols)):
            for k in range(ppm.ORDER + 1):
                counts.setdefault(tuple(symbols[i - k : i]), Counter())[symbols[i]] += 1
    return counts


def chance(counts, context, symbol):
    """The rule as it is written: escape downwards and leave out what was seen above."""
    left_out, p = set(), 1.0
    for k in range(ppm.ORDER, -1, -1):
        seen = {s: n for s, n in counts.get(tuple(context[len(context) - k :]), {}).items() if s not in left_out}
        if not seen:
            continue
        whole = sum(seen.values()) + len(seen)
        if symbol in seen:
            return p * seen[symbol] / whole
        p *= len(seen) / whole
        left_out |= set(seen)
    return p / (ppm.SYMBOLS - len(left_out))


def direct(counts, text):
    symbols = [ppm.START] * ppm.ORDER + list((text or "").encode()) + [ppm.END]
    return sum(math.log10(chance(counts, symbols[i - ppm.ORDER : i], symbols[i])) for i in range(ppm.ORDER, len(symbols)))


def model_of(texts):
    keys = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in ppm.blocks(pa.array(texts, pa.string()))]])
    keys, counts = np.unique(keys, return_counts=True)
    orders = [(keys, counts)]
    for order in range(ppm.ORDER - 1, -1, -1):
        keys, where = np.unique(orders[-1][0] & ((1 << ppm.BITS * (order + 1)) - 1), return_inverse=True)
        orders.append((keys, np.bincount(where, orders[-1][1], minlength=len(keys)).astype(np.int64)))
    return ppm.Model(ppm.trie(orders[::-1]))


def code_lengths(model, text):
    return sum(model.scores(keys).sum() for keys, _ in ppm.blocks(pa.array([text], pa.string())))


def test_scores_are_those_of_the_rule():
    model, counts = model_of(TEXTS), counted(TEXTS)
    for text in TEXTS + ["abrab", "zzz", "\xff\x00ab", "the bat"]:
        assert code_lengths(model, text) == pytest.approx(direct(counts, text), abs=1e-9)
    assert sum(chance(counts, list(b"abra"), s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_long_texts_are_scored_in_blocks(monkeypatch):
    model = model_of(TEXTS)
    whole = code_lengths(model, "abracadabra the cat" * 20)
    monkeypatch.setattr(ppm, "BLOCK", 5)
    assert code_lengths(model, "abracadabra the cat" * 20) == pytest.approx(whole)


def test_a_model_of_nothing_is_uniform():
    assert code_lengths(model_of([]), "ab") == pytest.approx(-3 * math.log10(ppm.SYMBOLS))


@pytest.mark.parametrize("top", [1 << 17, 3])
def test_columns(spark, monkeypatch, top):
    monkeypatch.setattr(ppm, "TOP_WORDS", top)
    rows = [(k, t, "x") for k, t in enumerate(TEXTS * 6)] + [(5, TEXTS[5], "y"), (None, "the dog", "z"), (77, "New words HERE", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    assert any(held(i) for i, _, _ in rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"]
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    model = counted([t for i, t, _ in rows if not held(i)])
    got = ppm.scored(docs, ~ppm.held_out(F.col("doc_id"))).collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6), round(r[5], 6))
    expected = [
        (i, len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
         sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), direct(model, t))
        for i, t, _ in rows
    ]
    assert sorted(map(key, got)) == sorted(map(key, expected)) and {r.train_tokens for r in got} == {n}


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r.doc: r for r in ppm.scored(docs, F.lit(False)).collect()}
    assert (rows[1].n_known, rows[1].train_tokens) == (0, 0) and rows[2].score == pytest.approx(-math.log10(257))
    assert ppm.scored(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("entries", [2, 9, 40])
def test_a_trie_larger_than_what_is_sent_gives_the_same_scores(spark, monkeypatch, entries):
    monkeypatch.setattr(ppm, "ENTRIES", entries)
    texts = TEXTS + ["abrab", "zzz", "\u00ff\x01ab", "the bat", "abracadabra the cat" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = counted(TEXTS)
    got = {r.doc: r.score for r in ppm.scored(docs, F.col("doc_id") < len(TEXTS)).collect()}
    assert got == {k: pytest.approx(direct(counts, text), abs=1e-9) for k, text in enumerate(texts)}
