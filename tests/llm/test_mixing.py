import random
import re
from collections import Counter

import pytest

from pairwell.llm.mixing import in_order, mix, repeated, targets


def expected(rows):
    """Sizes and targets by dealing the excess again and again."""
    size = Counter()
    for _, source, text in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    rest, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / whole > 2 * size[s] + 1e-9]
        if not over:
            target |= {s: rest * weight[s] / whole for s in open_}
            break
        target |= {s: 2 * size[s] for s in over}
        open_ -= set(over)
        rest -= sum(target[s] for s in over)
    return size, target


def table(seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "B", "z"][: 7 - seed]
    rows = [(i, rng.choice(sources), " ".join(["w"] * rng.choice([0, 1, 5, 50]))) for i in range(300)]
    return rows + [(900, "big", "w " * 5000), (901, "solo", None), (None, "a", "x\x0by z")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_targets_and_copies(spark, seed):
    rows = table(seed)
    size, target = expected(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mix(docs)
    got = mixed.collect()
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for row in got:
        assert row.mix_source_size == size[row.source]
        assert row.mix_target == pytest.approx(target[row.source])
        assert 0 <= row.mix_taken <= 2 * row.mix_size and row.mix_taken == row.mix_copies * row.mix_size
        taken[row.source] += row.mix_taken
        largest[row.source] = max(largest[row.source], row.mix_size)
    for source in size:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6
    again = {(r.doc_id, r.mix_taken) for r in mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.mix_taken) for r in got}
    out = repeated(mixed)
    assert out.columns == docs.columns and out.count() == sum(r.mix_copies for r in got)


def test_repeated_rows_are_taken_alike_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(1, "s", "a b c")] * 4 + [(2, "s", "d e")] * 3, "doc_id long, source string, text string")
    copies = {}
    for row in mix(docs).collect():
        assert copies.setdefault(row.doc_id, row.mix_copies) == row.mix_copies
    assert mix(docs.limit(0)).count() == 0


def test_columns_with_names_of_the_mix(spark):
    names = "target certain odds mix_rank mix_size mix_id others w level turn"
    docs = spark.createDataFrame([(k, "s", "a b c") for k in range(5)], "doc_id long, source string, text string")
    wide = docs.selectExpr("*", *[f"{k} AS {name}" for k, name in enumerate(names.split())])
    got = mix(wide)
    assert got.columns[:12] == [c for c in wide.columns if c != "mix_size"]
    plain = {r.doc_id: r.mix_taken for r in mix(docs).collect()}
    assert {r.doc_id: (r.mix_taken, r.target, r.others) for r in got.collect()} == {d: (t, 0, 6) for d, t in plain.items()}


def test_rows_of_no_id_are_not_taken_all_or_none(spark):
    docs = spark.createDataFrame([(None, "s", f"w{k} b c") for k in range(300)], "doc_id long, source string, text string")
    taken = sum(r.mix_taken for r in mix(docs).collect())
    assert abs(taken - 1.5 * 900) <= 3


def test_targets_in_ranges(spark):
    """Numbers and sums over several ranges of sources are those of one."""
    rows = [(f"s{k:03}" if k else None, (k * 37) % 101) for k in range(90)]
    sizes = spark.createDataFrame(rows, "mix_source string, source_size long")
    got = {r.mix_source: r.turn for r in in_order(sizes, ["mix_source"], {}).collect()}
    names = sorted(s for s, _ in rows if s) + [None]
    assert got == {s: k + 1 for k, s in enumerate(names)}
    found = {r.mix_source: r.target for r in targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    weight, size = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, dict(rows)
    free, rest = set(names), 1.5 * sum(size.values())
    expected = {}
    while True:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            break
        expected |= {s: 2.0 * size[s] for s in full}
        rest -= sum(2 * size[s] for s in full)
        free -= full
    expected |= {s: level * weight[s] for s in free}
    assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-6 for s in names)
