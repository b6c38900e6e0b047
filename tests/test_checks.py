"""A stream of answers with restarts gives what one batch gives, and what the rules say."""

import random

from strophe.streaming import checks

SCHEMA = "source string, at_ms long, online boolean, songs int, tag string, status int, failed boolean"


def test_rules(spark):
    rows = [
        ("a", 1000, True, 5, "x", 200, False), ("a", 1500, True, 5, "y", 200, False), ("a", 2100, True, 5, "y", 500, False), ("a", 3200, True, 5, "y", 200, None), ("a", 4300, True, 5, None, 200, False),
        ("a", 5400, True, 5, "y", 200, False), ("b", 1000, None, 5, "x", 200, False), ("b", 1100, True, None, "x", 200, False), ("b", 1200, True, 1, "x", 200, True), ("b", 2300, True, 1, "x", 200, False),
        (None, 1, True, 1, "x", 200, False), ("b", None, True, 1, "x", 200, False),
    ]
    got = [tuple(r) for r in checks.watched(spark.createDataFrame(rows, SCHEMA), 1000).orderBy("source", "at_ms").collect()]
    assert got == [
        ("a", 1000, True, False, "x"), ("a", 1500, False, False, "x"), ("a", 2100, True, False, "x"), ("a", 3200, True, True, "y"), ("a", 4300, True, False, "y"), ("a", 5400, True, False, "y"),
        ("b", 1000, False, False, ""), ("b", 1100, False, False, ""), ("b", 1200, True, False, ""), ("b", 2300, True, False, "x"),
    ]
    assert checks.watched(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("abcde"), 1000 * k + rng.randrange(900), rng.random() < 0.9, rng.randrange(3), rng.choice("xyz"), rng.choice([200, 200, 304, 500]), rng.random() < 0.1) for k in range(240)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):  # the stream ends and starts again after each part
        spark.createDataFrame(rows[80 * part : 80 * part + 80], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = checks.watch(spark.readStream.schema(SCHEMA).parquet(path), 7000)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, checks.watched(spark.createDataFrame(rows, SCHEMA), 7000).collect()))
    assert got == want and any(r[3] for r in got)
