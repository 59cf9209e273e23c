import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import pairwell.llm.token_files as files
from pairwell.session import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["hello world", None, "", "a " * 3000, "<|endoftext|> x<|endoftext|>", "b", "c" * 50]


@pytest.mark.parametrize("file_tokens, block, packed", [(7, 3, False), (500, 2, True), (100000, 5, False)])
def test_counts_are_those_of_the_library(spark, monkeypatch, file_tokens, block, packed):
    monkeypatch.setattr(files, "BLOCK_TOKENS", block)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = shared_dir(spark, "tokens-test")
    named = files.write_tokens(docs, folder, PATH, file_tokens=file_tokens, packed=packed)
    got = files.document_counts(named, files.token_counts(spark, folder, 50256)).orderBy("ordinal").collect()
    start = 0
    for row, (doc, text) in zip(got, rows, strict=True):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (row.doc, row.n_tokens, row.first_token) == (doc, n, start)
        start += n + 1


def test_streams_of_others(spark, tmp_path):
    streams = {"s1": [[1, 2, 9, 3], [4, 4], [], [5, 9, 9, 7]], "s2": [[7]], "s3": [[9]], "s4": [[]]}
    for name, parts in streams.items():
        (tmp_path / name).mkdir()
        for k, part in enumerate(parts):
            np.array(part, "<u2").tofile(tmp_path / name / f"{k}.bin")
    rows = files.token_counts(spark, str(tmp_path), 9).orderBy("stream", "ordinal").collect()
    assert [tuple(r) for r in rows] == [
        ("s1", 0, 0, 2, True),
        ("s1", 1, 3, 4, True),
        ("s1", 2, 8, 0, True),
        ("s1", 3, 9, 1, False),
        ("s2", 0, 0, 1, False),
        ("s3", 0, 0, 0, True),
    ]


def test_empty_table(spark):
    folder = shared_dir(spark, "tokens-test")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert files.write_tokens(empty, folder, PATH).count() == 0
