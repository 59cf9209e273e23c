"""Keys, ids and output encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_key(url: Column) -> Column:
    """URL without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_extract(url, r"\A[^?#]*", 0), r"/+\z", "")


def file_stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def stored_name(path: Column) -> Column:
    """Base name behind an id that stays the same when a task is repeated."""
    return F.concat_ws("_", F.sha2(path, 256), F.substring_index(path, "/", -1))


def utc_iso(moment: Column) -> Column:
    """UTC time as ``2024-01-31T08:00:00Z``, whatever the session time zone."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hash_strings(signature: Column) -> Column:
    """Signature as stored by systems that keep it in string form."""
    return F.transform(signature, lambda value: F.concat(F.lit("hash_"), value.cast("string")))


def zero_vector(dim: int) -> Column:
    """All-zero vector: stands for "no query"."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
