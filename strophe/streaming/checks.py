"""Change detection over a stream of answers, with the last check and the tag of each source as state.

Rows are what a source answered at a time: (source, at_ms, online, songs, tag, status, failed). Each source's
rows are taken in the order of their times: a check is due when the source is online, has songs and its
cooldown has passed; it is counted from the time of the check, whether the request failed or not. A tag
changes where a due request succeeds with another one than the source's; the new one is then stored, as is
the first one. Rows between checks change nothing. What comes out does not depend on how rows are dealt over
batches as long as a source's rows come in order, so a stream that is stopped and goes on from its checkpoint
gives what one batch gives.

Defined cases: rows without a source or a time take no part; a null ``online`` is false, null ``songs`` are
none, a null ``tag`` is empty; rows of one time go by tag, then status; a row that is older than the last
check of its source is not due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strophe.operators.changes import COOLDOWN_MS

OUT = "source string, at_ms long, due boolean, changed boolean, tag string"
STATE = "last_ms long, tag string"


def _answers(answers: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~F.coalesce(F.col("failed"), F.lit(False))
    able = F.coalesce(F.col("online"), F.lit(False)) & (F.coalesce("songs", F.lit(0)) > 0)
    rows = answers.filter("source is not null and at_ms is not null")
    return rows.select(F.col("source").cast("string").alias("source"), F.col("at_ms").cast("long").alias("at_ms"), able.alias("able"), F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("status", F.lit(0)).cast("int").alias("status"), ok.alias("ok"))


def _checked(source: str, rows: pd.DataFrame, last_ms: int | None, stored: str, cooldown_ms: int) -> tuple[pd.DataFrame, int | None, str]:
    """The verdict of every row, and the state behind the last one."""
    out = []
    for r in rows.sort_values(["at_ms", "tag", "status"], kind="stable").itertuples(index=False):
        due = bool(r.able) and (last_ms is None or r.at_ms - last_ms >= cooldown_ms)
        fresh = due and bool(r.ok) and r.tag != ""
        changed = fresh and stored != "" and r.tag != stored
        last_ms, stored = int(r.at_ms) if due else last_ms, r.tag if fresh else stored
        out.append((source, int(r.at_ms), due, changed, stored))
    return pd.DataFrame(out, columns=["source", "at_ms", "due", "changed", "tag"]), last_ms, stored


def watch(answers: DataFrame, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """(source, at_ms, due, changed, tag) of every row of the stream; ``tag`` is the stored one behind the row."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ms, stored = state.get if state.exists else (None, "")
        rows = pd.concat(list(batches), ignore_index=True)  # one source's rows of one micro-batch
        out, last_ms, stored = _checked(key[0], rows, last_ms, stored, cooldown_ms)
        state.update((last_ms, stored))
        yield out

    return _answers(answers).groupBy("source").applyInPandasWithState(each, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def watched(answers: DataFrame, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """The same of a whole table at once. A task walks its sources batch by batch in order, so that a source of
    any length is never held whole."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, last_ms, stored = None, None, ""
        for b in batches:
            for source, rows in b.groupby("source", sort=False):
                if source != before:
                    before, last_ms, stored = source, None, ""
                out, last_ms, stored = _checked(source, rows, last_ms, stored, cooldown_ms)
                yield out

    rows = _answers(answers)
    return rows.repartition("source").sortWithinPartitions("source", "at_ms", "tag", "status").mapInPandas(each, OUT)
