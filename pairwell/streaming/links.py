"""Link stream without repeats."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairwell.functions.encode import url_key

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def new_links(
    found: DataFrame, history: DataFrame | None = None, time: str | None = None, within: str = "30 days"
) -> DataFrame:
    """Links of a stream by key, each passed on once.

    ``found`` has ``url`` and ``url_key``. Links in the static ``history`` are left
    out. With ``time`` the remembered keys are dropped after ``within``, which
    bounds the state; without it every key is remembered.
    """
    found = _unknown(found, history)
    if time is None:
        return found.dropDuplicates(["url_key"])
    return found.withWatermark(time, within).dropDuplicatesWithinWatermark(["url_key"])


def _unknown(found: DataFrame, history: DataFrame | None) -> DataFrame:
    if history is None:
        return found
    seen = history.select(url_key(F.col("url")).alias("url_key")).distinct()
    return found.join(seen, "url_key", "left_anti")


# --- state that ends by itself ------------------------------------------------------------


def new_links_for(found: DataFrame, ttl_ms: int, history: DataFrame | None = None) -> DataFrame:
    """Links of a stream by key, each passed on once within ``ttl_ms`` of processing time.

    As ``new_links``, but a key is forgotten that long after it was passed on, so the state holds the keys of that
    time only; within it the result is the same. Of the links of a key in one batch, the first by all columns is
    passed on. Start a query that stops at the end of its input ``without_empty_batches``: Spark would run
    batches without input for ever, to look for keys whose time is over.
    """
    found = _unknown(found, history)
    order = [c for c in found.columns if c != "url_key"]

    def first_seen(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for part in parts:
            best = part.sort_values(order, kind="stable").head(1)
            first = best if first is None else pd.concat([first, best]).sort_values(order, kind="stable").head(1)
        now = state.getCurrentProcessingTimeMs()
        # The state of a key that comes after its time may not have timed out yet.
        known = state.exists and now - state.get[0] < ttl_ms
        if known:
            state.setTimeoutDuration(max(1, state.get[0] + ttl_ms - now))
        else:
            state.update((now,))
            state.setTimeoutDuration(ttl_ms)
            yield first

    return found.groupBy("url_key").applyInPandasWithState(
        first_seen, found.schema, "passed_on long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


@contextmanager
def without_empty_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started here run batches for input only; state that is over goes with the next one."""
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(EMPTY_BATCHES, before)
