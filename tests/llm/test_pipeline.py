import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pairwell.llm.common import kept
from pairwell.session import shared_dir


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(9)
    rows, labels = [], []
    vocabulary = {lang: [lang + "".join(rng.choices("abcdefgh", k=5)) for _ in range(300)] for lang in ("xa", "yo")}
    for k in range(240):
        lang = rng.choice(["xa", "yo"])
        words = rng.choices(vocabulary[lang], k=rng.randint(40, 90))
        if k % 6 == 0:
            words = [w + "***" for w in words]
        rows.append((k, " ".join(words), lang, rng.choice(["s", "t", None]), 0))
        labels.append((k, int(k % 6 != 0), 0))
    copied = [k for k in range(40) if k % 6]
    rows += [(1000 + k, rows[k][1], rows[k][2], "s", 0) for k in copied]
    rows += [(2000 + k, rows[k][1] + " end", rows[k][2], "t", 0) for k in copied]
    rows += [(3000, None, "xa", "s", 0), (3001, "1 2 3 " + " ".join(map(str, range(40))), None, "s", 0), (None, rows[1][1], "xa", None, 0)]
    path = shared_dir(spark, "pipeline-test")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, kept(stage(spark, docs, folder), "stage-test")
        after[name] = [r.asDict() for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert set(map(str, (r["doc_id"] for r in after[name]))) <= set(map(str, (r.doc_id for r in before.collect())))
    ids = lambda name: {r["doc_id"] for r in after[name]}
    good = {k for k in range(240) if k % 6}
    assert good <= ids("quality rules") and 3000 not in ids("quality rules")
    assert len([k for k in ids("quality rules") if k is not None and k < 240 and k % 6 == 0]) <= 2
    assert good <= ids("language") and 3001 not in ids("language")
    # Exact and near copies go, their first stays.
    assert {k for k in ids("near copies") if k is not None and 1000 <= k < 3000} == set()
    assert good <= ids("near copies")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in after["mixing"]}
    assert len(after["tokens"]) == len(after["mixing"])
    for row in after["tokens"]:
        assert row["token_ids"] == library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(row["token_ids"])


def test_columns_with_the_names_that_stages_use(spark, folder):
    names = "sample_id sample_lang gone_id again_id one_id target certain odds mix_size mix_copies kept rule s others row token_ids ids doc language"
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 120 OR doc_id >= 1000")
    docs = docs.selectExpr("*", *[f"{k} AS {name}" for k, name in enumerate(names.split())])
    extras = tuple(range(len(names.split())))
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, kept(stage(spark, docs, folder), "stage-test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert {tuple(r)[5:] for r in docs.collect()} == {extras}
    assert docs.count() > 50


def test_empty_documents(spark, folder):
    path = shared_dir(spark, "pipeline-test")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    rows = corpus_pipeline.run(spark, path)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and rows.count() == 0


def test_ids_that_do_not_decode_to_the_text_end_the_job(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "xa", "s"), (2, None, "xa", "s"), (3, "é\n", None, None)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in corpus_pipeline.token_stage(spark, docs, "").collect()} == {1, 2, 3}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        broken = json.load(file)
    broken["model"]["vocab"]["a"] = broken["model"]["vocab"]["z"]
    (tmp_path / "broken.json").write_text(json.dumps(broken), encoding="utf-8")
    monkeypatch.setattr(public_tokenizers, "path", lambda name: str(tmp_path / "broken.json"))
    with pytest.raises(Exception, match="do not decode"):
        corpus_pipeline.token_stage(spark, docs, "").collect()
