import hashlib
import random

import pytest

import pairwell.llm.fingerprint as fp


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = [sentence(rng, n) for n in (1, 3, 20, 60, 200, 400, 800, 50, 90)]
    return out + ["", "a", "é😀", out[4], out[5]]


def changed(text, share, rng):
    return "".join(c if rng.random() > share else rng.choice(["", c + "x", "q"]) for c in text)


def test_likeness_falls_with_the_number_of_edits(texts):
    rng = random.Random(2)
    long = texts[4:7]
    own = fp.fingerprints(long)
    means = []
    for share in (0, 0.002, 0.01, 0.05, 0.3):
        means.append(sum(map(fp.alike, own, fp.fingerprints([changed(t, share, rng) for t in long]))) / len(long))
    assert means == sorted(means, reverse=True) and means[0] == 1 and means[1] > 0.85 and means[2] > 0.6 and means[4] < 0.15
    assert fp.alike(own[0], own[1]) < 0.2


def test_blocks_slices_and_neighbours_change_nothing(monkeypatch, texts):
    whole = fp.fingerprints(texts)
    assert whole[4] == whole[12] and whole[5] == whole[13] and whole[9] == "0" * fp.SLOTS
    assert [fp.fingerprints([t])[0] for t in texts] == whole
    for block in (300, 1000):
        monkeypatch.setattr(fp, "BLOCK", block)
        assert fp.fingerprints(texts) == whole


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = fp.fingerprints([text, edited, following])
        out.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fp.alike(a, b), fp.alike(a, c)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_every_row_meets_the_next(spark, texts, parts):
    rows = list(enumerate(texts)) + [(None, "no id"), (None, None), (3, texts[3]), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, edge string").repartition(parts)
    got = sorted((str(r[0]), *r[1:]) for r in fp.with_fingerprints(docs).collect())
    assert got == brute(rows)


def test_one_row_and_no_row(spark):
    docs = spark.createDataFrame([(1, "only text")], "doc_id long, text string")
    assert [tuple(r)[5:] for r in fp.with_fingerprints(docs).collect()] == [(pytest.approx(brute([(1, "only text")])[0][5]), 1.0)]
    assert fp.with_fingerprints(docs.limit(0)).count() == 0


def test_search_finds_near_texts(spark):
    rng = random.Random(3)
    base = [sentence(rng, 300) for _ in range(60)]
    near = [changed(t, 0.001, rng) for t in base]
    rows = [(k, t) for k, t in enumerate(base + near + [base[0]] * 5)]
    prints = [(k, f) for (k, _), f in zip(rows, fp.fingerprints([t for _, t in rows]))]
    table = spark.createDataFrame(prints, "doc long, fingerprint string")
    found = {(r.query, r.doc): r.likeness for r in fp.search(table.filter("doc < 60"), table, 0.8).collect()}
    known = dict(prints)
    first = {f: min(d for d, g in prints if g == f) for _, f in prints}
    wanted = {(q, d) for q in range(60) for d in first.values() if fp.alike(known[q], known[d]) >= 0.9}
    assert len(wanted) > 90 and len(wanted & set(found)) >= 0.95 * len(wanted)
    assert all(found[q, d] == pytest.approx(fp.alike(known[q], known[d])) for q, d in found)
