import shutil
import uuid

import pytest
from pyspark.sql import functions as F

import table_queries
from pairwell.operators import embed
from pairwell.operators.once import with_once


@pytest.fixture
def documents(spark, tmp_path):
    """Folders of tables with the same documents: as one file, and as a folder of two."""
    rows = [(i, f"word{i} and more\nlater {i} lines" if i % 4 else None, "en", "web", 10 + i) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    (tmp_path / "file").mkdir()
    (tmp_path / "folder").mkdir()
    frame.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    shutil.copy(part, tmp_path / "file" / "documents.parquet")
    shutil.copy(part, tmp_path / "file" / "other.parquet")
    frame.repartition(2).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    return tmp_path


def test_a_table_in_a_folder_streams_as_one_file_does(spark, documents):
    counts = [table_queries.q_stream_balance(spark, str(documents / kind)).first().asDict() for kind in ("file", "folder")]
    assert counts[0] == counts[1]
    assert counts[0]["received"] == 12 + 12 + 12 + 4 and counts[0]["missing"] == 0


@pytest.mark.parametrize("query", [table_queries.q_compacted_postings, table_queries.q_stored_bands])
def test_batches_of_the_same_rows_enrich_them_once(spark, documents, monkeypatch, query):
    seen = spark.sparkContext.accumulator(0)
    plain = table_queries.posting_messages

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    def messages(frame):
        return with_once(plain(frame).withColumnRenamed("value", "sent"), "value", counted("sent")).drop("sent")

    monkeypatch.setattr(table_queries, "posting_messages", messages)
    assert query(spark, str(documents / "file")).count() > 0
    assert seen.value == 12


def test_a_vector_store_is_asked_by_keys_alone(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(embed, "shared_dir", lambda _, purpose: f"{tmp_path}/shared/{purpose}-{uuid.uuid4().hex}")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(str(documents / "file" / "benchmark.parquet"))
    rows = {r.doc_id: r for r in table_queries.q_stored_vectors(spark, str(documents / "file")).collect()}
    assert (rows[1].first_calls, rows[1].last_calls) == (5, 13) and rows[0].characters is None and rows[3].body_blanks == 2
    names = {tuple(spark.read.parquet(str(path)).columns) for path in (tmp_path / "shared").iterdir()}
    assert names == {("text_key", "vector"), ("text_key", "vector", "error")}
