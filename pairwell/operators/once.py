"""Columns that must be computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column.

    A filter on a plain computed column moves below the projection and computes
    the column a second time. It cannot move below an explode.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))
