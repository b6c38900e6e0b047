"""The folder of song texts changes as a whole."""

import os

import pytest
from pyspark.sql import functions as F

from strophe.sources import song_folder


def files(spark, names):
    return spark.createDataFrame([(f"{k:04d}.txt", f"#{k} t\n\nй{k}\n") for k in names], "file string, text string")


def read(spark, path):
    return {r["file"]: r["text"] for r in song_folder.read(spark, path).collect()}


def test_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "songs")
    assert read(spark, path) == {}
    song_folder.write(files(spark, range(300)).repartition(7), path)
    assert read(spark, path) == {f"{k:04d}.txt": f"#{k} t\n\nй{k}\n" for k in range(300)}
    song_folder.write(files(spark, range(5, 9)), path)  # stale texts go
    assert set(read(spark, path)) == {f"{k:04d}.txt" for k in range(5, 9)}
    assert len(os.listdir(path)) == 2 and not [f for f in os.listdir(song_folder.current(path)) if f.startswith(".")]


def test_a_failed_task_leaves_the_old_set(spark, tmp_path):
    path = str(tmp_path / "songs")
    song_folder.write(files(spark, range(20)), path)
    before, names = read(spark, path), sorted(os.listdir(path))
    bad = files(spark, range(100)).repartition(4).withColumn("text", F.when(F.col("file") == "0077.txt", F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        song_folder.write(bad, path)
    assert read(spark, path) == before and sorted(os.listdir(path)) == names
    with pytest.raises(Exception, match="replaced as a whole"):
        files(spark, [1]).write.format("song_folder").mode("append").save(path)
    song_folder.write(files(spark, []), path)
    assert read(spark, path) == {}
