"""Nearest neighbours by collision-counting hashing.

Every vector is projected on ``projections`` random directions; each direction has one sorted array.
A query opens a window around its own projection in each array (query-centred buckets), and all windows
are widened together, round by round, by a factor (virtual rehashing: no table is built again); a window is
two places of its array, and a vector has collided if its own place lies between them. A
vector that falls into at least ``threshold`` of the windows is a candidate and is verified with its
exact score. A query's search ends once ``share`` of the shard's vectors plus five times ``k`` have been verified,
or once the k best lie within the approximation radius; if neither happens, the windows end up covering
the whole shard, so that nothing is lost by a cap.

Vectors of unequal length are lifted by one coordinate that makes them equally long (and queries by a
zero), which turns the largest inner product into the smallest distance. Scores always come from the
original vectors, in double precision.

Vectors are dealt over shards and queries over blocks; a cell (shard, block) is one bounded task, and a
query's bests from all shards are merged by rank. Every row is indexed; no sample is fitted.

Defined cases: vectors that are null, zero, of another length than the most common one, or that hold
null or non-finite components take no part, as queries or candidates; rows with a null id neither; a
repeated id is one candidate, with the best score of its rows, never for itself, and one query, with what
any of its rows finds; ties go to the smaller id;
fewer than ``k`` candidates are all returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def usable(embedding: str = "embedding") -> Column:
    """True for vectors that can take part."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def search_cell(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, longest: float,
    k: int, projections: int, threshold: float, share: float, growth: float, seed: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of at most ``k`` neighbours of each query in one shard, of different ids."""
    n, dim = vectors.shape
    axes = np.random.default_rng(seed).standard_normal((dim + 1, projections))
    lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    data = (np.c_[vectors, lift] @ axes).T
    order = np.argsort(data, axis=1, kind="stable")
    arrays, small = np.take_along_axis(data, order, axis=1), np.uint16 if n < 1 << 16 else np.uint32
    places = np.empty(order.shape, small)  # of each vector in each array
    np.put_along_axis(places, order, np.arange(n, dtype=small)[None], axis=1)
    tally = np.uint8 if projections < 256 else np.int64
    norms = np.linalg.norm(queries, axis=1, keepdims=True)
    centres = (queries / norms * longest) @ axes[:-1]
    need, budget = int(np.ceil(threshold * projections)), share * n + 5 * k
    first = max(float(arrays.std()), 1e-9) * 0.8
    name = np.unique(ids, return_inverse=True)[1]
    several = name.max(initial=0) + 1 < n

    def place(at: np.ndarray, side: str) -> np.ndarray:
        return np.stack([np.searchsorted(a, c, side) for a, c in zip(arrays, at.T, strict=True)], 1)

    def kth(done: np.ndarray, scores: np.ndarray) -> float | None:
        """The k-th best score of different ids so far."""
        best = scores[done]
        if several:
            each = np.full(name.max() + 1, -np.inf)
            np.maximum.at(each, name[done], best)
            best = each[each > -np.inf]
        return float(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else None

    past, inside = np.empty_like(places), np.empty(places.shape, bool)
    windows: list[tuple[np.ndarray, np.ndarray]] = []  # both ends of every window, a pair for each round
    out_q, out_v, out_s = [], [], []
    for q in range(len(queries)):
        done, scores = np.zeros(n, bool), np.full(n, -np.inf)
        mine = ids == query_ids[q]
        others, radius, step = n - int(mine.sum()), first, 0
        while True:
            if step == len(windows):
                windows.append((place(centres - radius, "left"), place(centres + radius, "right")))
            begin, end = (side[q] for side in windows[step])
            # places before the window wrap around to large ones
            np.subtract(places, begin.astype(small)[:, None], out=past)
            np.less(past, (end - begin).astype(small)[:, None], out=inside)
            counts = inside.view(np.uint8).sum(axis=0, dtype=tally)
            new = np.flatnonzero((counts >= need) & ~done & ~mine)
            if len(new):
                done[new] = True
                scores[new] = np.einsum("ij,j->i", np.take(vectors, new, axis=0, mode="clip"), queries[q])
            if int(done.sum()) >= min(budget, others):
                break
            worst = kth(done, scores)
            if worst is not None and np.sqrt(max(0.0, 2 - 2 * worst / (norms[q, 0] * longest))) * longest <= radius / growth:
                break
            radius, step = radius * growth, step + 1
        at = np.flatnonzero(done)
        if not several and len(at) > k:  # all that are level with the k-th best; only these are put in order
            best = scores[at]
            at = at[best >= np.partition(best, len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[at], -scores[at]))]
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])][:k]
        out_q.append(np.full(len(at), q))
        out_v.append(at)
        out_s.append(scores[at])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = 64, threshold: float = 0.65, share: float = 0.15,
    growth: float = 1.35, seed: int = 11, shard_rows: int = 3000, block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``.

    Both frames: (vec_id, embedding). ``share`` is what a query verifies of a shard at most before it
    may end; recall against brute force is measured in the tests.
    """
    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return own.filter(F.col("vec_id").isNotNull() & usable())

    data, asked = clean(vectors), clean(queries)
    sizes = data.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("sq"))
    best = sizes.orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if best is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, longest = best["dim"], float(np.sqrt(best["sq"]))
    data, asked = data.filter(F.size("embedding") == dim), asked.filter(F.size("embedding") == dim)
    shards, blocks = max(1, -(-best["n"] // shard_rows)), max(1, -(-asked.count() // block_rows))
    # the row's place keeps shards even when an id repeats
    left = data.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(key: tuple, d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if d.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, y = np.stack(d["embedding"].to_list()), np.stack(q["embedding"].to_list())
        ids, names = d["vec_id"].to_numpy(np.int64), q["vec_id"].to_numpy(np.int64)
        once = np.unique(np.c_[ids.view(float), x], axis=0, return_index=True)[1] if len(np.unique(ids)) < len(ids) else slice(None)  # rows that repeat
        ids, x = ids[once], x[once]
        at, v, s = search_cell(ids, x, names, y, longest, k, projections, threshold, share, growth, seed)
        return pd.DataFrame({"query_id": names[at], "vec_id": ids[v], "score": s})

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


