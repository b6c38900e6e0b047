"""Hard negatives by a pivot table: brackets of inner products from stored distances.

Vectors are lifted by one coordinate that makes them equally long, anchors by a zero, which turns the inner
product into a distance: the squared distance of an anchor q and a vector v is |q|^2 + R^2 - 2 q.v, R the
longest length. Every vector's distances to a few pivots are stored in a written table. For an anchor the
triangle inequality over these brackets each distance from both sides, and so each score; vectors are
checked exactly in the order of their upper brackets until no other one can still count.

Two passes over the table: the first finds each anchor's positives, the second, with their scores known, the
negatives whose brackets reach the range that a positive allows. Rows are dealt over shards and anchors over
blocks; a cell (shard, block) is one bounded task that gives at most ``k`` rows for each thing asked, and
these are merged by rank. Pivots are chosen from a bounded sample of ``sample`` rows, each the farthest from
those before; they bear on the work alone, never on results. Every row stands in the table.

Scores are exact integers: whole components are summed in double precision where no sum can reach 2^53 and
as Python integers beyond, where a score that no long can hold is given as the nearest long and one of more
than 38 digits is taken for the largest of 38.

Defined cases: rows with a null id, label or vector, an empty vector, null or non-finite components, or
another length than the most common one take no part; of rows that repeat an id one takes part, the smallest
by label, then vector; ties go to the smaller id; fewer than ``k`` rows are all returned; an anchor without
positives or a positive without negatives has no rows; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.llm.common import materialize

#: Rows checked first, for a bound on what the others must reach.
FIRST = 128


def whole(embedding: Column, scale: int = 256) -> Column:
    """Components as whole numbers: floor(scale * x) in double precision, null where one is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = F.transform(embedding.cast("array<double>"), lambda x: F.when(F.abs(x) < 1e15, F.floor(scale * x).cast("double")).otherwise(scale * x))
    return F.when(finite, own)


def _taking_part(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that take part, one an id, and how long their vectors are (0: none)."""
    v = F.col("vector")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    common = own.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return own, 0
    own = own.filter(F.size("vector") == common["dim"])
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector"), common["dim"]


def pivots(rows: DataFrame, longest: float, count: int = 16, sample: int = 2048) -> np.ndarray:
    """``count`` lifted vectors of a sample of ``sample`` rows, each the farthest from those before."""
    some = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(sample).collect()]
    x = _lifted(np.array(some, float), longest)
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(count, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))]


def _apart(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (chosen**2).sum(1) - 2 * x @ chosen.T, 0))


def _with_distances(rows: DataFrame, chosen: np.ndarray, longest: float, lift: bool) -> DataFrame:
    """``rows`` and ``apart``, the distances to the pivots; anchors are lifted by zero."""

    def each(batches):
        for b in batches:
            if len(b):
                x = np.array(b["vector"].to_list(), float)
                x = _lifted(x, longest) if lift else np.c_[x, np.zeros(len(x))]
                yield b.assign(apart=list(_apart(x, chosen)))

    return rows.mapInPandas(each, rows.schema.simpleString()[7:-1] + ",apart:array<double>")


class _Scores:
    """Brackets and exact scores of one shard for one anchor after another."""

    def __init__(self, d: pd.DataFrame, dim: int, longest: float, chosen: int) -> None:
        self.ids, self.labels = d["vec_id"].to_numpy(np.int64), d["label"].to_numpy(np.int64)
        self.x = np.array(d["vector"].to_list(), float).reshape(-1, dim)
        self.apart = np.array(d["apart"].to_list(), float).reshape(-1, chosen)
        self.longest, self.exact, self.checked = longest, longest**2 < 2**53, 0
        if not self.exact:
            self.big = np.array([[int(c) for c in row] for row in self.x.tolist()], object).reshape(self.x.shape)

    def ask(self, vector: np.ndarray, apart: np.ndarray) -> None:
        both = float(vector @ vector) + self.longest**2
        low = np.abs(self.apart - apart).max(1)
        high = (self.apart + apart).min(1)
        slack = 1 + 1e-6 * both  # above what rounding can do to a bracket
        self.upper, self.lower = (both - low**2) / 2 + slack, (both - high**2) / 2 - slack
        self.vector = vector if self.exact else np.array([int(c) for c in vector.tolist()], object)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows``."""
        self.checked += len(rows)
        return (self.x if self.exact else self.big)[rows] @ self.vector

    def best(self, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The first ``k`` (score, id) of ``rows`` by score, then id."""
        if len(rows) > 2 * FIRST >= 2 * k:
            head = rows[np.argpartition(-self.upper[rows], FIRST)[:FIRST]]
            reach = np.sort(self.of(head))[-k]
            rows = rows[self.upper[rows] >= float(reach) - 1]
        return self.top(rows, self.of(rows), k)

    def top(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        if len(rows) > k:
            able = scores >= (np.partition(scores, len(rows) - k) if self.exact else np.sort(scores))[len(rows) - k]
            rows, scores = rows[able], scores[able]
        order = sorted(zip((-scores).tolist(), self.ids[rows].tolist(), strict=True))[:k]
        return [(-int(s), i) for s, i in order]


def _long(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _text(score: int) -> str:
    """For a decimal of 38 digits."""
    return str(max(-(10**38 - 1), min(10**38 - 1, score)))


def _first(found: DataFrame, k: int, score: str, vec_id: str, *by: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, count: int = 16, sample: int = 2048, shard_rows: int = 4096, block_rows: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: (vec_id, label, vector) with whole components; ``anchors``: which of them ask. An anchor's
    positives are its first ``positives`` other rows of the same label, by inner product. For each the first
    ``k`` rows of other labels are given whose score is ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    own, dim = _taking_part(rows)
    if not dim:
        return spark.createDataFrame([], schema)
    own = materialize(own, "vectors")
    size = own.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("sq")).first()
    longest = float(np.sqrt(size["sq"]))
    chosen = pivots(own, longest, count, sample)
    shards = max(1, -(-size["n"] // shard_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    pivot_table = materialize(_with_distances(own, chosen, longest, True).withColumn("shard", deal(shards)), "pivot-table")
    asked = materialize(_with_distances(own.filter(anchors), chosen, longest, False), "anchors")
    blocks = max(1, -(-asked.count() // block_rows))
    left = pivot_table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    spread = lambda a: a.withColumns({"block": deal(blocks), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))}).groupBy("shard", "block")

    def positive(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out, s = [], _Scores(d, dim, longest, len(chosen))
        for vec_id, label, v, apart in zip(a["vec_id"].tolist(), a["label"].tolist(), a["vector"], a["apart"], strict=True):
            s.ask(np.asarray(v, float), np.asarray(apart))
            out += [(vec_id, i, _text(x)) for x, i in s.best(np.flatnonzero((s.labels == label) & (s.ids != vec_id)), positives)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "score"])

    # scores as decimals of 38 digits where a long may be too small
    found = left.cogroup(spread(asked)).applyInPandas(positive, "anchor_id long, positive_id long, score string").withColumn("score", F.col("score").cast("decimal(38,0)"))
    best = _first(found, positives, "score", "positive_id", "anchor_id").groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", F.col("score").cast("string").alias("score"))).alias("wanted"))
    wanted = asked.join(best, asked["vec_id"] == best["anchor_id"]).drop("anchor_id")

    def negative(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out, s = [], _Scores(d, dim, longest, len(chosen))
        for vec_id, label, v, apart, these in zip(a["vec_id"].tolist(), a["label"].tolist(), a["vector"], a["apart"], a["wanted"], strict=True):
            s.ask(np.asarray(v, float), np.asarray(apart))
            scored = [int(w["score"]) for w in these]
            # what no bracket rules out for any of the positives is checked once
            able = np.flatnonzero((s.labels != label) & (s.ids != vec_id) & (s.upper * 100 >= low * min(scored)) & (s.lower * 100 <= high * max(scored)))
            scores = s.of(able)
            for w, p in zip(these, scored, strict=True):
                fits = (100 * scores >= low * p) & (100 * scores <= high * p)
                out += [(vec_id, w["positive_id"], i, _long(p), _text(x)) for x, i in s.top(able[fits], scores[fits], k)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "score"])

    hard = left.cogroup(spread(wanted)).applyInPandas(negative, "anchor_id long, positive_id long, negative_id long, positive_score long, score string").withColumn("score", F.col("score").cast("decimal(38,0)"))
    top = _first(hard, k, "score", "negative_id", "anchor_id", "positive_id")
    least, most = F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")
    return top.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.least(F.greatest("score", least), most).cast("long").alias("negative_score"))
