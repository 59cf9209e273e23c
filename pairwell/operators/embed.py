"""Text to vectors: a built-in hashed bag of words, or a caller's model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.text import tokens
from pairwell.operators.hashing import hashed_tokens, some_at_a_time
from pairwell.session import shared_dir
from pairwell.sources.vectors import KEPT, VectorStore

DIM = 1536
VECTOR = T.ArrayType(T.FloatType())
VECTORS = T.StructType(
    [T.StructField("text_key", T.StringType()), T.StructField("vector", VECTOR), T.StructField("error", T.StringType())]
)

# Called once per task; returns a function from texts to vectors.
Embedder = Callable[[], Callable[[list[str]], list[list[float]]]]


def hash_embed(text: Column, dim: int = DIM) -> Column:
    """``hash_embed_words`` of the words of a text."""
    return hash_embed_words(tokens(text), dim)


def hash_embed_words(words: Column, dim: int = DIM) -> Column:
    """Signed counts of hashed words: deterministic, per row, no shuffle.

    Not scaled to unit length; cosine does not depend on length. No words
    give the zero vector.
    """

    def counted(lists: pa.Array) -> pa.Array:
        lengths, codes, hashes = hashed_tokens(lists)
        place = (hashes % np.uint64(dim)).astype(np.int64)
        sign = 1.0 - 2.0 * (hashes // np.uint64(dim) % np.uint64(2)).astype(np.float64)
        cell = np.repeat(np.arange(len(lists)), lengths) * dim + place[codes]
        total = np.bincount(cell, sign[codes], minlength=len(lists) * dim).astype(np.float32)
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(total))

    @F.arrow_udf(VECTOR)
    def count(lists: pa.Array) -> pa.Array:
        return some_at_a_time(lists, counted)

    return count(words)


def embed(
    df: DataFrame,
    text: str,
    vector: str,
    embedder: Embedder | None = None,
    dim: int = DIM,
    **options,
) -> DataFrame:
    """``embed_columns`` for one text column."""
    return embed_columns(df, {text: vector}, embedder, dim, **options)


def embed_columns(
    df: DataFrame,
    columns: Mapping[str, str],
    embedder: Embedder | None = None,
    dim: int = DIM,
    tasks: int | None = None,
    on_error: str = "raise",
    error: str = "embed_error",
    store: VectorStore | None = None,
) -> DataFrame:
    """Add a vector column for every text column; null where the text is null or empty.

    A caller's model sees every distinct non-empty text of all columns once, however many
    rows share it, and is set up once per task. It runs here, not when the result is read:
    its vectors are written to a shared folder, so nothing that reads the result, however
    often, calls it again. ``tasks`` sets how many tasks run a slow model.

    ``on_error`` tells what a text does on which the model fails: ``raise`` ends the job,
    ``zero`` gives it the zero vector, ``reject`` gives it none and states why in the column
    ``error`` of its rows. A failing batch is tried again text by text.

    With a ``store`` the model sees only texts whose vector is not there yet, and its vectors are added. A
    text on which it fails is not stored, so a later job tries it again.
    """
    if on_error not in ("raise", "zero", "reject"):
        raise ValueError("on_error must be raise, zero or reject")
    if embedder is None:
        made = {v: F.when(F.col(t) != "", hash_embed(F.col(t), dim)) for t, v in columns.items()}
        rejects = {error: F.lit(None).cast("string")} if on_error == "reject" else {}
        return df.withColumns(made | rejects)
    keys = {t: F.when(F.col(t) != "", F.sha2(F.col(t), 256)) for t in columns}
    entries = F.array(*[F.struct(keys[t].alias("text_key"), F.col(t).alias("text")) for t in columns])
    texts = df.select(F.inline(entries)).filter(F.col("text_key").isNotNull()).dropDuplicates(["text_key"])
    if store is not None:
        # Keys alone ask the store, so that the texts themselves move once, to be made distinct.
        asked = df.select(F.explode(F.array(*keys.values())).alias("text_key")).filter(F.col("text_key").isNotNull())
        path = shared_dir(df.sparkSession, "known-vectors")
        store.known(asked.distinct()).write.parquet(path)
        known = df.sparkSession.read.schema(KEPT).parquet(path)
        texts = texts.join(known.select("text_key"), "text_key", "left_anti")
    if tasks is not None:
        texts = texts.repartition(tasks)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for batch in batches:
            vectors, errors = _encoded(model, batch["text"].tolist(), on_error, dim)
            yield pd.DataFrame({"text_key": batch["text_key"], "vector": vectors, "error": errors})

    path = shared_dir(df.sparkSession, "vectors")
    texts.mapInPandas(encode, VECTORS).write.parquet(path)
    vectors = df.sparkSession.read.schema(VECTORS).parquet(path)
    if store is not None:
        # Rejects and zero vectors are no vectors of the model.
        made = vectors.filter(F.col("vector").isNotNull() & F.col("error").isNull())
        if on_error == "zero":
            made = made.filter(F.exists("vector", lambda x: x != 0))
        if not made.isEmpty():
            store.add(made, f"part-{uuid.uuid4().hex}")
        vectors = vectors.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    # Left joins: Spark splits a text that very many rows share, and rows without text, at run time.
    # All keys come first, so that a join moves no text that only a later key needs.
    df = df.withColumns({f"text_key_{number}": keys[text] for number, text in enumerate(columns)})
    for number, vector in enumerate(columns.values()):
        key = f"text_key_{number}"
        found = vectors.select(F.col("text_key").alias(key), F.col("vector").alias(vector), F.col("error").alias(f"error_{number}"))
        df = df.join(found, key, "left").drop(key)
    reasons = [f"error_{number}" for number in range(len(columns))]
    if on_error == "reject":
        df = df.withColumn(error, F.coalesce(*reasons))
    return df.drop(*reasons)


def _encoded(model, texts: list[str], on_error: str, dim: int) -> tuple[list, list]:
    """Vectors of the texts and why there is none."""
    try:
        return list(model(texts)), [None] * len(texts)
    except Exception as failure:
        if on_error == "raise":
            raise
        if len(texts) == 1:
            return ([[0.0] * dim], [None]) if on_error == "zero" else ([None], [str(failure) or type(failure).__name__])
    each = [_encoded(model, [text], on_error, dim) for text in texts]
    return [v for vectors, _ in each for v in vectors], [e for _, errors in each for e in errors]
