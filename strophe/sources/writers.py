"""Sinks: bundles, song texts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.operators.parse import song_to_text


def json_bundle(songs: DataFrame, path: str) -> None:
    """One JSON object a line and song; Spark's commit protocol makes the folder whole or absent."""
    songs.write.mode("overwrite").json(path)


def sections(rows: DataFrame, path: str) -> None:
    rows.select("title", "song_ns").write.mode("overwrite").json(path)


def song_texts(songs: DataFrame, path: str, splits: int = 1024) -> None:
    """Texts under ``bucket=``, one row (n, text) a song in Parquet, in place of what stood there.

    A file for each song does not scale (a store lists millions of objects slowly); rows keyed by number
    do, and ``n`` alone is read to find one.
    """
    rows = song_to_text(songs).withColumn("bucket", F.pmod(F.col("n"), F.lit(splits)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "n").write.mode("overwrite").partitionBy("bucket").parquet(path)


def song_files(songs: DataFrame, path: str) -> None:
    """A text file for each song, under ``file=NNNN.txt``: for small collections that editors work on."""
    rows = song_to_text(songs).select(F.concat(F.lpad(F.col("n").cast("string"), 4, "0"), F.lit(".txt")).alias("file"), F.regexp_replace("text", r"\n\z", "").alias("text"))
    rows.repartition("file").write.mode("overwrite").partitionBy("file").text(path)  # ends each text with a line end


def replace_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
