"""The tables of a folder as songs, links, collections and versions, and the same in SQL.

Songs with markup come from ``conversations``: user turns are verses, assistant turns choruses. Labels,
marks and meta blocks are set by remainders of the id, so that every rule meets rows. ``documents`` give
plain songs of two variants. Expressions that both engines read alike are shared text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import search

NL = "chr(10)"
SONG_NUMBER = "CASE WHEN l_orderkey % 13 = 5 THEN l_partkey + 1000000000 ELSE l_partkey END"
FILE = "concat(CASE WHEN conv_id % 31 = 9 THEN 'x' ELSE '' END, lpad(CAST(conv_id AS STRING), CAST(greatest(4, length(CAST(conv_id AS STRING))) AS INT), '0'), '.txt')"
MARKED = "CASE conv_id % 4 WHEN 1 THEN concat('/', text, ' /2р.') WHEN 2 THEN concat('{Am}', text) WHEN 3 THEN concat('[тихо] ', text) ELSE text END"
LABEL = f"CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN concat('(а)', {NL}) WHEN conv_id % 5 = 0 AND turn = 2 THEN concat('(б)', {NL}) ELSE '' END"
PIECE = f"concat({LABEL}, CASE role WHEN 'user' THEN concat(CAST(turn + 1 AS STRING), '. ', {MARKED}) WHEN 'assistant' THEN concat('Припев:', {NL}, {MARKED}) ELSE {MARKED} END)"
HEAD = f"concat(CASE WHEN conv_id % 19 = 7 THEN 'Song ' ELSE '#' END, CAST(CASE WHEN conv_id % 23 = 5 THEN conv_id + 1 ELSE conv_id END AS STRING), ' ', trim(split_part(first, {NL}, 1)))"


def _block(*lines: str) -> str:
    return "concat(" + f", {NL}, ".join(f"'{x}'" for x in lines) + ")"


META = (
    f"CASE WHEN conv_id % 11 = 4 THEN {_block('@meta', '@end')} WHEN conv_id % 13 = 6 THEN {_block('@meta', 'meter: 8')}"
    f" WHEN conv_id % 17 = 8 THEN {_block('@meta', 'meter: 8', 'meter: 7', 'bad line', 'foo: 1', '', 'rhyme:', 'note: n', '@end')}"
    f" WHEN conv_id % 18 = 10 THEN {_block('@end', '', '@meta')} ELSE {_block('@meta', 'meter: 8', 'rhyme: ABAB', 'note: n', '@end')} END"
)
SPACED = f"CASE WHEN conv_id % 7 = 3 THEN replace(body, concat({NL}, {NL}), concat({NL}, '  ', {NL})) ELSE body END"
TEXT = (
    f"concat({HEAD}, {NL}, CASE WHEN conv_id % 29 = 3 THEN '' ELSE {NL} END, CASE WHEN conv_id % 3 = 1 THEN concat({META}, {NL}, {NL}) ELSE '' END,"
    f" {SPACED}, CASE WHEN conv_id % 3 = 0 THEN concat({NL}, {NL}, {META}, {NL}) ELSE '' END)"
)
#: The new version of a song text: a change for each check.
CHANGED = (
    "CASE conv_id % 12 WHEN 1 THEN lower(text) WHEN 2 THEN replace(text, ',', ' ,') WHEN 3 THEN lower(replace(text, '.', ' .')) WHEN 4 THEN replace(text, ' the ', ' a ')"
    " WHEN 5 THEN replace(text, '/2р.', '') WHEN 6 THEN replace(text, '{Am}', '{C}') WHEN 7 THEN replace(text, '#', '#1') WHEN 8 THEN replace(text, '@end', '')"
    f" WHEN 9 THEN concat(text, {NL}, {NL}, '9. la') WHEN 10 THEN replace(text, '{{Am}}', '') WHEN 11 THEN replace(text, ' les ', ' des ') ELSE text END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, file, text)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.expr(PIECE).alias("piece"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "\n\n")
    whole = turns.groupBy("conv_id").agg(body.alias("body"), F.min_by("text", "turn").alias("first"))
    return whole.select("conv_id", F.expr(FILE).alias("file"), F.expr(TEXT).alias("text"))


def song_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_files(spark, sf_dir).select("file", "text")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, old_text, new_text): every 37th has no old version, every 41st no new one."""
    rows = keyed_files(spark, sf_dir)
    return rows.select("file", F.expr("CASE WHEN conv_id % 37 = 11 THEN NULL ELSE text END").alias("old_text"), F.expr(f"CASE WHEN conv_id % 41 = 13 THEN NULL ELSE {CHANGED} END").alias("new_text"))


def document_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as songs."""
    return songs_of(table(spark, sf_dir, "documents"))


def songs_of(docs: DataFrame) -> DataFrame:
    """(number, title, variants): a document's first line is the title, its lines go to two variants."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    part = lambda x: F.struct(x.alias("content"))
    variant = lambda r: F.struct(F.lit("" if r == 0 else "б").alias("label"), F.transform(F.filter("l", lambda x, i: i % 2 == r), part).alias("body"))
    rows = docs.select(F.col("doc_id").alias("number"), lines.alias("l"))
    return rows.select("number", F.get("l", F.lit(0)).alias("title"), F.array(variant(0), variant(1)).alias("variants"))


def document_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prepare_variants(document_songs(spark, sf_dir))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collections; every 5000th is a favourite one."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.expr("CASE WHEN o_orderkey % 5000 = 7 THEN 1 END").alias("isFavorite"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderdate").alias("updatedAt"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links; some have no variant, those of every thirteenth order lead to no song."""
    x = table(spark, sf_dir, "lineitem")
    variant = F.expr("CASE WHEN l_linenumber % 9 = 0 OR l_linenumber = 3 THEN NULL ELSE l_linenumber - 1 END").cast("int")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("collectionId"), F.expr(SONG_NUMBER).alias("songNumber"), variant.alias("variantIndex"))


def part_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as songs."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("title"))


# The same in DuckDB SQL, as named parts of a WITH clause.
CTE = {
    "turns": f"SELECT conv_id, turn, text, {PIECE} AS piece FROM conversations",
    "whole": "SELECT conv_id, string_agg(piece, chr(10) || chr(10) ORDER BY turn) AS body, min_by(text, turn) AS first FROM turns GROUP BY conv_id",
    "keyed": f"SELECT conv_id, {FILE} AS file, {TEXT} AS text FROM whole",
    "files": "SELECT file, text FROM keyed",
    "versions": f"SELECT file, CASE WHEN conv_id % 37 = 11 THEN NULL ELSE text END AS old_text, CASE WHEN conv_id % 41 = 13 THEN NULL ELSE {CHANGED} END AS new_text FROM keyed",
    "doc_lines": "SELECT doc_id AS number, string_split(coalesce(text, ''), chr(10)) AS l FROM documents",
    "doc_variants": r"""SELECT number AS n, v AS variantIndex, l[1] AS title,
      list_transform(list_filter(l, lambda x, i: (i - 1) % 2 = v), lambda x: trim(regexp_replace(regexp_replace(x, '[/\[\]()!?.,;:"''-]', ' ', 'g'), '\s+', ' ', 'g'))) AS parts
      FROM doc_lines, (VALUES (0), (1)) t(v)""",
    "prepared": r"""SELECT n::VARCHAR || ':' || v.variantIndex::VARCHAR AS ref, n, title AS raw_title,
      trim(regexp_replace(regexp_replace(title, '[/\[\]()!?.,;:"''-]', ' ', 'g'), '\s+', ' ', 'g')) AS title,
      coalesce(array_to_string(parts, ' '), '') AS content, variantIndex FROM doc_variants v""",
    "flat": r"""SELECT n::VARCHAR AS n, raw_title AS title, variantIndex, regexp_replace(lower(title), '\s+', '', 'g') AS titleFlat,
      regexp_replace(lower(title || ' ' || content), '\s+', '', 'g') AS textFlat FROM prepared""",
    "collections": "SELECT o_orderkey AS id, o_orderpriority AS name, CASE WHEN o_orderkey % 5000 = 7 THEN 1 END AS isFavorite, o_orderdate AS createdAt, o_orderdate AS updatedAt FROM orders",
    "links": f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS collectionId, {SONG_NUMBER} AS songNumber, CAST(CASE WHEN l_linenumber % 9 = 0 OR l_linenumber = 3 THEN NULL ELSE l_linenumber - 1 END AS INT) AS variantIndex FROM lineitem",
    "songs": "SELECT p_partkey AS number, p_name AS title FROM part",
}
FILES = ("turns", "whole", "keyed", "files")
VERSIONS = ("turns", "whole", "keyed", "versions")
DOCS = ("doc_lines", "doc_variants", "prepared")


def sql(parts: tuple[str, ...], body: str, /, **more: str) -> str:
    """``body`` after a WITH clause of the named parts and of ``more``."""
    clauses = [f"{p} AS ({CTE[p]})" for p in parts] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + body
