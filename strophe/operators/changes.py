"""Change detection: cooldown, tag comparison and reload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COOLDOWN_MS = 30 * 60 * 1000


def should_check(last_ms: Column, now_ms: Column, cooldown_ms: int = COOLDOWN_MS) -> Column:
    """True without a last check, or once the cooldown has passed."""
    return (F.coalesce(last_ms, F.lit(0)) == 0) | (now_ms - last_ms >= cooldown_ms)


def etag_changed(cases: DataFrame) -> DataFrame:
    """``cases`` (stored, new, status, failed, ...) with changed and new_etag."""
    bad = F.coalesce(F.col("failed"), F.lit(False)) | ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    new, stored = F.coalesce("new", F.lit("")), F.coalesce("stored", F.lit(""))
    return cases.withColumns({"changed": ~bad & (stored != "") & (new != "") & (new != stored), "new_etag": F.when(bad, F.col("stored")).otherwise(new)})


def perform_check(state: DataFrame, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """``state`` (online, last_ms, now_ms, songs, ...) with due and the new last_ms.

    The time is set before the request, so a failing one starts the cooldown too.
    """
    due = F.col("online") & should_check(F.col("last_ms"), F.col("now_ms"), cooldown_ms) & (F.col("songs") > 0)
    return state.withColumn("due", due).withColumn("last_ms", F.when(F.col("due"), F.col("now_ms")).otherwise(F.col("last_ms")))


def apply_update(songs: DataFrame, incoming: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(songs, links, dangling): songs replaced as a whole, links kept; ``dangling`` lead to no song any more."""
    return incoming, links, links.join(incoming.select(F.col("number").alias("songNumber")).distinct(), "songNumber", "left_anti")
