"""Files that arrive in a folder, as streams (an extension: the songbook only polls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strophe.operators import lint, parse


def text_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(file, text) of each new ``.txt`` file."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", per_trigger).load(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def ingest(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Headers and violations of each batch, appended under ``out``; a batch that is repeated after a
    failure overwrites its own folder, so nothing is counted twice."""

    def batch(df: DataFrame, epoch: int) -> None:
        parse.parse_header(df).write.mode("overwrite").parquet(f"{out}/headers/epoch={epoch}")
        lint.lint(df).write.mode("overwrite").parquet(f"{out}/violations/epoch={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
