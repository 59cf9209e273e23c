import random
import re
from collections import Counter

import pytest

import pairwell.llm.quality as quality

TEXTS = [
    None,
    "",
    " \n ",
    "a b\na b\n\n \na b",
    " ".join("abcdefghi" * 3),
    "\x0b\x0c é É ç",
    " ".join(["x"] * 9),
    " ".join(["x"] * 8),
    "a\r\na\r\na",
    "# $ <b> | &",
    " ".join(f"w{k % 11}" for k in range(200)),
    "😀 " * 5000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def random_texts(n):
    rng = random.Random(2)
    return [" ".join(rng.choices(["a", "b", "c\n", "#d"], k=rng.randint(0, 40))) for _ in range(n)]


def test_counts_and_base_rule(spark):
    texts = TEXTS + random_texts(150)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, words string")
    for row in quality.judged(docs, []).collect():
        want = brute(row.text)
        assert tuple(row.quality_stats[c] for c in quality.COUNTS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert (row.base_failed, row.kept, row.rule) == (failed, not failed, 0)
    assert quality.judged(docs.limit(0), []).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "words AS kept", "1 AS s", "2 AS rule", "3 AS others", "4 AS judged_text", "5 AS packed")
    judged = quality.judged(clashing, [])
    assert judged.columns == ["doc_id", "text", "s", "others", "judged_text", "packed", "quality_stats", "base_failed", "rule", "kept"]
    assert {tuple(r[2:6]) for r in judged.collect()} == {(1, 3, 4, 5)}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 80))]
        if bad and k % 2:
            words = [w + "###" for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, None if k % 50 == 49 else int(not bad), 0))
    labels += [(None, 0, 0), (9999, 1, 0), (1, 1, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_learned_rules_reject_what_labels_call_bad(labelled):
    docs, labels = labelled
    rules = quality.learned_rules(docs, labels)
    assert rules and all(1 <= len(r) <= quality.CONDITIONS for r in rules)
    wrong = [r.doc_id for r in quality.judged(docs, rules).collect() if r.kept == (r.doc_id % 3 == 0)]
    assert len(wrong) <= 3
    assert quality.learned_rules(docs, labels) == rules


def covered_brute(rows):
    """Sequential covering in plain Python: rows are (statistics, bad, prunes)."""
    cuts = None

    def holds(rule, stats):
        return all((stats[c.feature] >= c.threshold) == c.above for c in rule)

    def grow(rows):
        rule = ()
        while len(rule) < quality.CONDITIONS:
            inside = [r for r in rows if holds(rule, r[0])]
            p0, n0 = sum(b for _, b, _ in inside), sum(1 - b for _, b, _ in inside)
            if not p0 or not n0:
                break
            best, most = None, 1e-9
            for feature in quality.FEATURES:
                for threshold in cuts[feature]:
                    for above in (True, False):
                        part = [r for r in inside if (r[0][feature] >= threshold) == above]
                        p, n = sum(b for _, b, _ in part), sum(1 - b for _, b, _ in part)
                        if p + n < p0 + n0 and (value := quality.gain(p, n, p0, n0)) > most:
                            best, most = quality.Condition(feature, above, threshold), value
            if best is None:
                break
            rule += (best,)
        return rule

    def learn(given):
        nonlocal cuts
        cuts, rules = given, []
        left = list(rows)
        while True:
            bad = [prunes for _, b, prunes in left if b]
            if sum(bad) < quality.LEAST_COVERED or not len(bad) - sum(bad):
                return rules
            grown = grow([r for r in left if not r[2]])
            if not grown:
                return rules
            worth = []
            for k in range(1, len(grown) + 1):
                part = [b for s, b, prunes in left if prunes and holds(grown[:k], s)]
                p, n = sum(part), len(part) - sum(part)
                worth.append(((p - n) / max(p + n, 1), p, -k))
            share, p, k = max(worth)
            n = sum(1 - b for s, b, prunes in left if prunes and holds(grown[:-k], s))
            if p >= quality.LEAST_COVERED and p >= quality.PRECISION * (p + n):
                grown = grown[:-k]
                rules.append(grown)
            left = [r for r in left if not holds(grown, r[0])]

    return learn


@pytest.mark.parametrize("seed", range(2))
def test_sequential_covering_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(180):
        bad = int(rng.random() < 0.4)
        stats = {f: float(rng.randrange(4)) for f in quality.FEATURES}
        kind = rng.choice(["symbols", "capitals", "marks", "repeats"])
        if bad:
            stats[kind] = 6.0 + rng.randrange(2)
        elif rng.random() < 0.1:
            stats[kind] = 6.0
        rows.append((k, tuple(stats.values()), bad))
    names = ", ".join(f"{f}: double" for f in quality.FEATURES)
    labelled = spark.createDataFrame(rows, f"doc_id long, s struct<{names}>, bad long")
    folds = {r.doc_id: r.p for r in labelled.select("doc_id", (quality.fold(labelled.doc_id, 3) == 0).alias("p")).collect()}
    plain = [(dict(zip(quality.FEATURES, s)), b, int(folds[k])) for k, s, b in rows]
    rules = quality.learn(labelled)
    assert rules == covered_brute(plain)(quality.thresholds(labelled)) and len(rules) >= 2


def test_good_documents_are_those_that_are_judged_good(labelled):
    docs, labels = labelled
    wide = docs.selectExpr("*", "1 AS s", "2 AS kept", "3 AS rule", "4 AS label_id", "5 AS bad")
    got = quality.good_documents(wide, labels)
    assert got.columns == wide.columns
    judged = quality.judged(docs, quality.learned_rules(docs, labels)).filter("kept")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in judged.collect())


def test_the_main_path_has_no_python(labelled):
    docs, labels = labelled
    plan = quality.judged(docs, quality.learned_rules(docs, labels))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_without_labels_only_the_base_rule_rejects(labelled):
    docs, labels = labelled
    assert quality.learned_rules(docs, labels.limit(0)) == []
    assert quality.learned_rules(docs.limit(0), labels) == []
    assert quality.learned_rules(docs, labels.filter("quality = 1")) == []


def test_best_condition_is_the_one_of_most_gain():
    cuts = {name: [1.0, 2.0] for name in quality.FEATURES}
    table = {name: [(5, 5), (5, 5), (5, 5)] for name in quality.FEATURES} | {"symbols": [(0, 14), (1, 1), (14, 0)]}
    assert quality.best_condition(table, cuts) == quality.Condition("symbols", True, 2.0)
    assert quality.best_condition({name: [(0, 0)] * 3 for name in quality.FEATURES}, cuts) is None
