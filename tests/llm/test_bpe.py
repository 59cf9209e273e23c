import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import pairwell.llm.bpe as bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = list("aaabbb  eeettthhh's't 123\n\t\r\x0b\x0c\x1c\x1f\x85\xa0　éñß漢字😀🏽١Ⅷ‍!.?#") + ["<|endoftext|>", "'ll", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(PATH)))


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(2000)]
    return made + ["", None, "aaaaaaa" * 50, " " * 30, "x" * 3000, "ab" * 2000, "<|endoftext|>" * 3]


def test_ids_and_text_are_those_of_the_library(library, encoder):
    for text, ids in zip(texts(), encoder.encode(texts())):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert encoder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_blocks_and_memory_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 37)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 20)
    small = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(PATH)))
    for text, ids in zip(texts()[:300], small.encode(texts()[:300])):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_ids_that_are_no_text_decode_with_replacement(library, encoder):
    ids = [162, 120, 50256, 253, 262]
    assert encoder.decode(bpe.np.array(ids, bpe.np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_columns(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (2, None, "y"), (None, "é", None), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_text string")
    coded = bpe.with_text(bpe.with_ids(docs, PATH), PATH, text="again")
    for row in coded.collect():
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.again == (row.text or "")
    for row in bpe.round_trip(docs, PATH).collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        expected = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
        assert tuple(row.round_trip) == expected
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    # Columns of the result's name are replaced.
    assert bpe.with_ids(docs, PATH, ids="text").columns == docs.columns
    again = bpe.round_trip(docs.selectExpr("text", "1 AS round_trip"), PATH)
    assert again.columns == ["text", "round_trip"] and "struct" in dict(again.dtypes)["round_trip"]
    twice = spark.createDataFrame([("same text",)] * 3, "text string")
    assert len({tuple(r.round_trip) for r in bpe.round_trip(twice, PATH).collect()}) == 1
