import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import pairwell.llm.ngram_join as join
from pairwell.llm.components import components


def shingles(text, size):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1))


def brute(rows, size=4, percent=85):
    sets = {i: shingles(text, size) for i, text in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in sets.items():
        counts = Counter(j for x in s for j in lists[x])
        for x in s:
            lists[x].append(i)
        for j, n in counts.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    """Chains and stars of near copies, exact copies, short texts with many ties, and shared passages."""
    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(120)], []
    for g in range(2):
        words = [f"g{g}_{x}" for x in base]
        for _ in range(40):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            texts.append(" ".join(words))
    for k in range(150):
        words = [f"z{x}" for x in base]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 9])):
            words[rng.randrange(len(words))] = rng.choice([f"n{rng.random()}", "e1", "e2"])
        texts.append(" ".join(words[rng.randint(0, 9) if k % 7 == 0 else 0 :]))
    texts += [" ".join(rng.choices(["a", "b", "A"], k=rng.randint(0, 9))) for _ in range(60)]
    passage = [f"p{j}" for j in range(50)]
    texts += [" ".join(passage + [f"u{k}_{j}" for j in range(rng.choice([3, 5, 8, 12]))]) for k in range(50)]
    texts += ["É é", "é É", None, "", " \t"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("short, least, cell", [(24, 4, 256), (3, 2, 7)])
def test_components_are_exact(spark, monkeypatch, short, least, cell):
    monkeypatch.setattr(join, "SHORT", short)
    monkeypatch.setattr(join, "BLOCK_LEAST", least)
    monkeypatch.setattr(join, "CELL", cell)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.n, r.component) for r in join.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_divide_skip_finds_what_counting_finds():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 12)
        counts = Counter(x for one in lists for x in one)
        assert join.divide_skip(lists, least) == {x: n for x, n in counts.items() if n >= least}


def test_nulls_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text), (7, text), (3, text), (None, text), (5, None), (6, "one"), (8, "ONE")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    got = sorted((str(r.doc), r.n, r.component) for r in join.jaccard_components(docs).collect())
    assert got == sorted([("7", 27, 3), ("7", 27, 3), ("3", 27, 3), ("None", 27, None), ("5", 0, 5), ("6", 1, 6), ("8", 1, 6)])
    assert join.jaccard_components(docs.limit(0)).count() == 0
    stay = join.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["3", "5", "6", "None"]
    twice = spark.createDataFrame([(1, text), (1, text), (2, "other")], "doc_id long, text string")
    assert sorted(r.doc_id for r in join.one_of_each(twice).collect()) == [1, 2]


def test_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("b", text), ("a", text + " more"), ("c", "else")], "doc_id string, text string")
    assert {r.doc: r.component for r in join.jaccard_components(docs).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_bucket_counts_bound_the_overlap():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) for n in (1, 5, 300, 5000, 200_000)]
    sets += [np.unique(np.r_[s[: int(len(s) * share)], rng.integers(0, 1 << 63, len(s) // 8 + 1, dtype=np.uint64)]) for s in sets for share in (0.9, 0.99, 1)]
    rows = [(len(s), np.frombuffer(join.sketch(s), np.uint8)) for s in sets]
    sizes, counts = np.array([n for n, _ in rows]), np.stack([c for _, c in rows])
    passed = 0
    for s, row in zip(sets, rows):
        may = join.may_link(row, sizes, counts, 85)
        for other, ok in zip(sets, may):
            both = len(np.intersect1d(s, other))
            assert ok or 100 * both < 85 * (len(s) + len(other) - both)
            passed += ok
    assert passed < len(sets) ** 2 / 2


def test_documents_of_shared_clauses_move_few_texts(spark, monkeypatch):
    """Documents put together from two clauses each of many slots share frequent shingles, but none links."""
    rng = random.Random(6)
    moved = {}
    in_cells = join.in_cells

    def counted(pairs, rows, check):
        if "text" in rows.columns:
            moved[size] = moved.get(size, 0) + pairs.count()
        return in_cells(pairs, rows, check)

    monkeypatch.setattr(join, "in_cells", counted)
    clauses = [[" ".join(f"s{slot}c{c}w{k}" for k in range(12)) for c in range(2)] for slot in range(25)]
    for size in (60, 120):
        rows = [(k, " ".join(rng.choice(slot) for slot in clauses)) for k in range(size)]
        rows += [(1000 + k, text) for k, text in rows[:5]] + [(2000 + k, text + " end") for k, text in rows[:5]]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc: (r.n, r.component) for r in join.jaccard_components(docs).collect()}
        assert got == brute(rows)
    assert moved[120] <= 3 * 120 and moved[120] <= 3 * max(moved[60], 60)
