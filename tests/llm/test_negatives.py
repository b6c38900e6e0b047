"""Hard negatives by the pivot table against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import negatives

SCHEMA = "vec_id long, label int, vector array<double>"


def brute(rows, positives=5, k=5, low=80, high=100, every=10):
    out = set()
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out |= {(a, p, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)}
    return out


def result(df):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _rows(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim)) * spread
    return [(i, int(rng.integers(0, 4)), [float(math.floor(x)) for x in centres[rng.integers(0, 6)] * 40 + rng.standard_normal(dim) * 60]) for i in range(n)]


@pytest.mark.parametrize(("shard", "block"), [(4096, 4096), (40, 7)])
def test_against_all_pairs(spark, shard, block):
    rows = _rows(400, 12, 2.0, 3)
    rows += [(400 + i, i % 3, rows[5][2]) for i in range(60)]  # one vector many times: ties
    rows += [(500, 1, [0.0] * 12), (510, 2, [0.0] * 12)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, shard_rows=shard, block_rows=block)
    assert result(got) == brute(rows)


def test_brackets_hold(monkeypatch):
    """Every exact score lies between its brackets, and they are narrower than no bracket at all."""
    rows = _rows(300, 8, 4.0, 9)
    x = np.array([v for *_, v in rows])
    longest = float(np.sqrt((x**2).sum(1).max()))
    chosen = negatives._lifted(x[:16], longest)
    import pandas as pd

    d = pd.DataFrame({"vec_id": range(300), "label": [r[1] for r in rows], "vector": list(x), "apart": list(negatives._apart(negatives._lifted(x, longest), chosen))})
    s = negatives._Scores(d, 8, longest, 16)
    q = x[7]
    s.ask(q, negatives._apart(np.r_[q, 0][None], chosen)[0])
    exact = x @ q
    assert (s.lower <= exact).all() and (exact <= s.upper).all()
    assert (s.upper - s.lower).mean() < 2 * longest * np.linalg.norm(q)
    monkeypatch.setattr(negatives, "FIRST", 20)
    assert s.best(np.arange(300), 5) == sorted(((int(e), i) for i, e in enumerate(exact)), key=lambda t: (-t[0], t[1]))[:5]
    assert s.checked < 300  # the rest was left out by its bracket


def test_few_rows_and_other_limits(spark):
    rows = [(0, 1, [3.0, 4.0]), (1, 1, [5.0, 5.0]), (2, 2, [5.0, 4.0]), (3, 2, [5.0, 5.0]), (10, 7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(negatives.mine(df, F.col("vec_id") % 10 == 0)) == {(0, 1, 1, 3, 35, 35), (0, 1, 2, 2, 35, 31)}
    assert result(negatives.mine(df, F.col("vec_id") % 10 == 0, k=1, high=95)) == {(0, 1, 1, 2, 35, 31)}


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    good = [(0, 1, [2.0, 1.0]), (1, 1, [3.0, 3.0]), (2, 2, [3.0, 2.0]), (3, 2, [-3.0, 2.0])]
    bad = [(10, None, [1.0, 1.0]), (None, 1, [9.0, 9.0]), (20, 1, None), (30, 2, [nan, 1.0]), (40, 2, [inf, 1.0]), (50, 2, [None, 1.0]), (60, 2, []), (70, 2, [1.0, 2.0, 3.0])]
    again = [(2, 2, [3.0, 2.0]), (2, 3, [9.0, 9.0])]  # the smallest row of an id counts
    df = spark.createDataFrame([(*r, 1.0, 2, "x") for r in good + bad + again], SCHEMA + ", apart double, shard int, score string")
    assert result(negatives.mine(df, F.col("vec_id") % 10 == 0)) == brute(good)
    assert negatives.mine(df.limit(0), F.lit(True)).collect() == []


def test_large_components(spark):
    """Sums beyond 2^53 stay exact; what no long can hold is the nearest one."""
    rng = random.Random(2)
    rows = [(i, i % 3, [float(rng.randrange(-(2**30), 2**30)) for _ in range(4)]) for i in range(60)]
    assert result(negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == brute(rows)
    huge = [(0, 1, [1e15]), (1, 1, [1e15]), (2, 2, [0.9e15])]
    assert result(negatives.mine(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") % 10 == 0)) == {(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)}


def test_whole_components(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1e30],), ([None, 1.0],), ([float("nan")],), (None,), ([],)], "embedding array<float>")
    got = [r[0] for r in df.select(negatives.whole(F.col("embedding"))).collect()]
    assert got[0][:2] == [128.0, -1.0] and got[0][2] == 256 * float(np.float32(1e30))
    assert got[1:] == [None, None, None, []]


def test_query_over_whole_table(spark):
    from strophe.llm import queries

    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect():
        v = r["embedding"]
        if r["label"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in v]))
    assert result(queries.op13_pivot_hard_negatives(spark, "/root/testdata/sf0.01")) == brute(rows, every=100)
