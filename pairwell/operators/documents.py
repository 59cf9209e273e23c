"""Document bytes to text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.encode import file_stem, stored_name
from pairwell.functions.markup import inner_text

# Called once per task; returns a function from one document's bytes to its text.
Converter = Callable[[], Callable[[bytes], str]]


def convert_documents(
    files: DataFrame, converter: Converter | None = None, on_error: str = "raise"
) -> DataFrame:
    """``(path, name, stem, text, error)`` from ``(path, content)``.

    Without a converter the bytes are read as UTF-8, and HTML loses its tags.
    ``name`` is unique and safe to store under. A converter's exception ends the job, or with ``on_error="keep"`` becomes
    the row's ``error``.
    """
    if on_error not in ("raise", "keep"):
        raise ValueError("on_error must be raise or keep")
    if converter is None:
        body = F.decode("content", "UTF-8")
        is_html = F.regexp_like(F.lower("path"), F.lit(r"\.html?$"))
        text = F.when(is_html, inner_text(body)).otherwise(body)
        converted = files.select("path", text.alias("text"), F.lit(None).cast("string").alias("error"))
    else:
        converted = files.select("path", "content").mapInPandas(
            _converting(converter, on_error), "path string, text string, error string"
        )
    return converted.select(
        "path", stored_name(F.col("path")).alias("name"), file_stem(F.col("path")).alias("stem"), "text", "error"
    )


def _converting(converter: Converter, on_error: str):
    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_text = converter()

        def one(path: str, content: bytes) -> tuple[str, str | None, str | None]:
            try:
                return path, to_text(content), None
            except Exception as problem:
                if on_error == "raise":
                    raise
                return path, None, str(problem)

        for batch in batches:
            rows = [one(path, bytes(content)) for path, content in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return convert
