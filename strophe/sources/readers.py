"""Sources: text folders, bundles, side tables and selectors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.text import strip_space
from strophe.operators.ranking import best_of

BODY = "array<struct<id:long,n:long,type:string,content:string,repeatId:string>>"
SONG = f"struct<id:long,n:long,title:string,variants:array<struct<label:string,body:{BODY}>>,body:{BODY}>"
BUNDLE = f"songs array<{SONG}>, sections array<struct<title:string,song_ns:array<long>>>"


def text_dir(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row for each ``.txt`` file of a folder, or of its ``file=`` subfolders."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.col("file") if "file" in rows.columns else F.col("_metadata.file_name")
    return rows.select(name.cast("string").alias("file"), F.col("value").alias("text"))


def json_bundle(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, n, title, variants, body, ordinal): the songs of JSON bundles, one a file or (without
    ``multi_line``) one a line. Malformed ones fail the read."""
    bundle = spark.read.schema(BUNDLE).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return bundle.select(F.posexplode("songs").alias("ordinal", "s")).select("s.*", "ordinal")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, song_ns): id is the place in the file."""
    rows = spark.read.option("multiLine", False).text(path, wholetext=True)
    parsed = rows.select(F.posexplode(F.from_json("value", "array<struct<title:string,song_ns:array<long>>>")).alias("id", "s"))
    return parsed.select("id", "s.title", "s.song_ns")


def number_prefix(x):
    """The whole number that a string starts with, or null."""
    return F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")


def parse_names(rows: DataFrame) -> DataFrame:
    """(n, name) of ``rows`` (ordinal, line): tab-parted, blank lines skipped, the last of a number wins."""
    cut = rows.select("ordinal", strip_space(F.col("line")).alias("line")).filter(F.col("line") != "")
    both = cut.select("ordinal", number_prefix(F.get(F.split("line", "\t"), F.lit(0))).alias("n"), F.get(F.split("line", "\t"), F.lit(1)).alias("name")).filter(F.col("n").isNotNull() & (F.col("name") != ""))
    return best_of(both, ["n"], F.desc("ordinal")).select("n", strip_space(F.col("name")).alias("name"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, line) of small side files, each read whole."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ordinal", "line"))


def tsv_names(spark: SparkSession, path: str) -> DataFrame:
    return parse_names(numbered_lines(spark, path))


def parse_suppressions(rows: DataFrame) -> DataFrame:
    """(file_num, check) of ``rows`` (line): ``number | check``, # starts a comment, numbers padded to four."""
    cut = rows.select(strip_space(F.col("line")).alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    fields = F.transform(F.split("line", r"\|"), strip_space)
    both = cut.select(fields.alias("f")).filter(F.size("f") >= 2)
    return both.select(F.lpad(F.get("f", F.lit(0)), F.greatest(F.lit(4), F.length(F.get("f", F.lit(0)))), F.lit("0")).alias("file_num"), F.get("f", F.lit(1)).alias("check")).distinct()


def suppressions(spark: SparkSession, path: str) -> DataFrame:
    return parse_suppressions(numbered_lines(spark, path))


def git_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, old_text, new_text): two versions side by side; a file of one side alone keeps a null."""
    return old.select("file", F.col("text").alias("old_text")).join(new.select("file", F.col("text").alias("new_text")), "file", "full_outer")


def select_files(files: DataFrame, arguments: list[str] | None, changed: DataFrame | None = None) -> DataFrame:
    """The rows of ``files`` (file, ...) that ``arguments`` name: ``A-B``, a number or a file name.

    None stands for all files; ``changed`` (file) further restricts them.
    """
    spark = files.sparkSession
    out = files if changed is None else files.join(changed.select("file").distinct(), "file", "left_semi")
    if arguments is None:
        return out
    literal = [(a,) for a in arguments if a.endswith(".txt")]
    ranges = [tuple(sorted(map(int, m.groups()))) for a in arguments if (m := re.fullmatch(r"(\d{4})-(\d{4})", a)) and m[1] <= m[2]]
    ranges += [(int(a), int(a)) for a in arguments if re.fullmatch(r"\d{1,4}", a)]
    numbers = spark.createDataFrame(ranges, "a int, b int").select(F.explode(F.sequence("a", "b")).alias("n")).select(F.concat(F.lpad(F.col("n").cast("string"), 4, "0"), F.lit(".txt")).alias("file"))
    names = numbers.union(spark.createDataFrame(literal, "file string")).distinct()
    return out.join(F.broadcast(names) if sum(b - a + 1 for a, b in ranges) + len(literal) <= 100_000 else names, "file", "left_semi")


def fingerprint(files: DataFrame) -> tuple[int, int | None]:
    """What tells a table of files from a later one: their number, and their names, sizes and times in one number.

    Reads no column of the files.
    """
    each = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(each.agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first())
