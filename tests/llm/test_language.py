import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import pairwell.llm.language as language

#: Made-up languages; the first two and the last two share most syllables.
SYLLABLES = {
    "aa": "tha ren ing ould ster wen".split(),
    "ab": "tha ren ing ijk ster zen".split(),
    "ba": "que ción ado los mente ñor".split(),
    "bb": "que tion eau los ment oir".split(),
}


def text_of(lang, rng, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((k, text_of(lang, rng, rng.randint(8, 60)), lang if k % 11 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


@pytest.fixture(scope="module")
def model(docs):
    return language.learn(docs, F.col("doc_id") % 4 != 2)


def test_held_out_accuracy(docs, model):
    assert sorted(map(sorted, model.families)) == [["aa", "ab"], ["ba", "bb"]]
    rows = language.predicted(docs, model).filter("doc_id % 4 = 2").collect()
    right = sum(r.language.lang_pred == r.truth for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r.language.score <= 1 for r in rows)


def test_texts_without_letters_are_unknown(spark, model):
    texts = [None, "", "123 !?", "\n", "tharening Z"]
    rows = language.predicted(spark.createDataFrame([(t, "x") for t in texts], "text string, score string"), model).collect()
    assert [tuple(r.language) for r in rows[:4]] == [("und", 0.0)] * 4
    assert rows[4].language.lang_pred in SYLLABLES and rows[4].score == "x"


def test_slices_and_blocks_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = pa.array([text_of("ba", rng, n).upper() for n in (0, 1, 5, 400, 3, 90)] + [None])
    whole = np.concatenate([x for _, x in language.profiles(texts)])
    monkeypatch.setattr(language, "BLOCK", 64)
    assert np.array_equal(whole, np.concatenate([x for _, x in language.profiles(texts)]))


def test_few_or_no_languages(docs, spark):
    none = language.learn(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {tuple(r.language) for r in language.predicted(docs, none).collect()} == {("und", 0.0)}
    one = language.learn(docs.filter("truth = 'aa'"), F.lit(True))
    assert {r.language.lang_pred for r in language.predicted(docs, one).collect()} == {"aa"}
    assert language.predicted(docs.limit(0), one).count() == 0


def test_training_is_the_same_again(docs, model):
    again = language.learn(docs.repartition(3), F.col("doc_id") % 4 != 2)
    assert np.allclose(again.family_weights, model.family_weights)


def test_foreign_texts_are_told_from_short_clean_ones(spark):
    rng = random.Random(11)
    letters = lambda words: " ".join("".join(rng.choices("bcdfghjkpqvwxyz", k=rng.randint(2, 9))) for _ in range(words))
    rows = [(k, text_of(lang, rng, rng.randint(30, 90)), lang) for k, lang in enumerate(sorted(SYLLABLES) * 80)]
    planted = [(1000 + k, letters(rng.randint(20, 60)), None) for k in range(20)]
    planted += [(2000 + k, " ".join(rng.choices(["kamau", "wiki", "lolo", "hoku", "nui", "pua"], k=40)), None) for k in range(20)]
    planted += [(3000 + k, text_of("aa", rng, 30) + " " + text_of("ba", rng, 30), None) for k in range(20)]
    planted += [(4000 + k, text_of("bb", rng, 3), None) for k in range(20)] + [(5000, "12 34", None), (5001, None, None)]
    docs = spark.createDataFrame(rows + planted, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    count = lambda low: len([k for k in kept if low <= k < low + 1000])
    assert count(0) >= 0.97 * len(rows) and count(4000) >= 19
    assert count(1000) == count(2000) == count(5000) == 0 and count(3000) <= 2
    # Nothing to learn from: no text is in a known language.
    assert corpus_pipeline.language_stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0
    assert corpus_pipeline.language_stage(spark, docs.limit(0), "").count() == 0
