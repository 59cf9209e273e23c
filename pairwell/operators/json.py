"""Strict reading of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators.once import with_once

END = "end of message"


def with_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the text as element 0 of a variant array; null unless it is one JSON value.

    Spark's parser stops after the first value and ignores the rest, so the text
    is read as an array together with an end mark.
    """
    framed = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(f',"{END}"]')))
    read = with_once(df, name, framed)
    second = F.try_variant_get(name, "$[1]", "string")
    third = F.try_variant_get(name, "$[2]", "variant")
    return read.withColumn(name, F.when((second == END) & third.isNull(), F.col(name)))


def field(parsed: Column, name: str, as_type: str) -> Column:
    """A field of the parsed object; null if absent or of another type."""
    return F.try_variant_get(parsed, f"$[0].{name}", as_type)


def kind(parsed: Column, name: str | None = None) -> Column:
    """Type name of a field or of the whole value: STRING, BIGINT, VOID for null, ..."""
    path = "$[0]" if name is None else f"$[0].{name}"
    return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
