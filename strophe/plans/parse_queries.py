"""Sources, parsing and sinks bound to song texts made from ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.text import title_fallback
from strophe.operators import parse, store
from strophe.plans import bindings as b
from strophe.plans.bindings import FILES, VERSIONS, sql
from strophe.sources import readers, song_folder, writers
from strophe.sources.workspace import fresh_folder

SELECTED = ["0003-0020", "7", "42", "0050.txt", "9000-0001"]
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: Parsing in SQL, step by step: bodies, lines with variants, parts. Labels stand in lines of their own here.
STEPS = {
    "fl": "SELECT file, text, string_split(text, chr(10)) AS l FROM files",
    "heads": rf"SELECT file, regexp_matches(l[1], '^#\d+\s+.+$') AS ok, CAST(regexp_extract(l[1], '^#(\d+)\s+(.+)$', 1) AS VARCHAR) AS n, {TRIM.format(r"regexp_extract(l[1], '^#(\d+)\s+(.+)$', 2)")} AS title FROM fl",
    "bodies": rf"SELECT file, {TRIM.format(r"regexp_replace(" + TRIM.format("array_to_string(list_slice(l, CASE WHEN trim(l[2]) = '' THEN 3 ELSE 2 END, len(l)), chr(10))") + r", '@meta\n[\s\S]*?\n@end\n?', '')")} AS body FROM fl",
    "bl": f"SELECT file, pos, raw, {TRIM.format('raw')} AS t FROM (SELECT file, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM bodies)",
    "near": "SELECT *, lag(t) OVER (PARTITION BY file ORDER BY pos) AS prev, first_value(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM bl",
    "bound": r"SELECT file, pos, raw, t, regexp_full_match(raw, '\([^)]+\)\s*') AND (prev IS NULL OR prev = '') AND coalesce(regexp_matches(nxt, '^(\d+\.|Припев[:\s])'), false) AS is_label FROM near",
    "vl": "SELECT *, sum(is_label::INT) OVER (PARTITION BY file ORDER BY pos) AS v FROM bound",
    "vn": "SELECT file, pos, raw, t, is_label, CAST(v - min(v) OVER (PARTITION BY file) AS INT) AS variant, coalesce(max(CASE WHEN is_label THEN regexp_extract(t, '^.(.*).$', 1) END) OVER (PARTITION BY file, v), '') AS label FROM vl",
    "chunks": f"SELECT file, variant, label, coalesce({TRIM.format("string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT is_label)")}, '') AS content FROM vn GROUP BY ALL",
    "pl": r"SELECT *, CASE WHEN regexp_matches(t, '^\d+\.') THEN 'verse' WHEN regexp_matches(t, '(?i)^Припев.') THEN 'chorus' WHEN row_number() OVER (PARTITION BY file, variant ORDER BY pos) = 1 THEN 'headless' END AS kind FROM vn WHERE t <> '' AND NOT is_label",
    "pi": r"SELECT *, sum((kind IS NOT NULL)::INT) OVER (PARTITION BY file, variant ORDER BY pos) AS part, CASE kind WHEN 'verse' THEN regexp_extract(t, '^\d+\.\s*(.*)$', 1) WHEN 'chorus' THEN trim(substr(t, 8)) ELSE t END AS rest FROM pl",
    "pg": r"SELECT file, variant, label, CAST(part AS INT) AS part, CASE WHEN max(kind) = 'chorus' THEN 'chorus' ELSE 'verse' END AS type, max(CASE kind WHEN 'verse' THEN regexp_extract(t, '^\d+')::BIGINT WHEN 'headless' THEN 1 END) AS number, coalesce(string_agg(rest, chr(10) ORDER BY pos) FILTER (WHERE rest <> ''), '') AS content FROM pi GROUP BY file, variant, label, part",
    "parts": "SELECT file, variant, label, part, type, row_number() OVER (PARTITION BY file ORDER BY variant, part) - 1 AS id, CASE WHEN type = 'chorus' THEN row_number() OVER (PARTITION BY file, variant, type ORDER BY part) ELSE number END AS n, content FROM pg",
}
CHUNKS = ("fl", "heads", "bodies", "bl", "near", "bound", "vl", "vn", "chunks")
PARTS = (*CHUNKS, "pl", "pi", "pg", "parts")


def steps(names: tuple[str, ...], body: str, /, **more: str) -> str:
    return sql(FILES, body, **{k: STEPS[k] for k in names}, **more)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.split_variants(b.song_files(spark, sf_dir).select("file", parse.body_text(F.col("text")).alias("body")), ["file"])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.split_parts(_chunks(spark, sf_dir), ["file"])


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_songs(b.song_files(spark, sf_dir))


def _shown(variants: Column) -> Column:
    """Labels and parts of all variants, a line each (contents may have more)."""
    part = lambda p: F.concat_ws(":", p["type"], p["id"].cast("string"), p["n"].cast("string"), p["content"])
    return F.array_join(F.flatten(F.transform(variants, lambda v: F.concat(F.array(F.concat(F.lit("("), v["label"], F.lit(")"))), F.transform(v["body"], part)))), "\n")


def scan_text_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Song texts written as files and read back."""
    path = fresh_folder(spark, "texts")
    b.song_files(spark, sf_dir).repartition("file").write.partitionBy("file").text(path)  # ends each text with a line end
    return readers.text_dir(spark, path)


def sink_song_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "song-texts")
    writers.song_texts(_songs(spark, sf_dir), path)
    return spark.read.parquet(path).select("n", "text")


def sink_song_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each song, replaced as a whole, and read back."""
    path = fresh_folder(spark, "song-folder")
    song_folder.write(song_folder.song_rows(_songs(spark, sf_dir)), path)
    return song_folder.read(spark, path)


def scan_json_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of fifty songs each, a line a bundle."""
    path = fresh_folder(spark, "bundles")
    song = F.struct("id", "n", "title", "variants")
    rows = _songs(spark, sf_dir).groupBy(F.expr("id div 50").alias("bundle")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(song)).alias("songs"))).alias("value"))
    rows.select("value").write.text(path)
    return readers.json_bundle(spark, path, multi_line=False).select("id", "n", "title", F.size("variants").alias("n_variants"))


def sink_json_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "json")
    writers.json_bundle(_songs(spark, sf_dir), path)
    return spark.read.schema("id long, n long, title string").json(path).select("id", "n", "title")


def scan_tsv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat(CAST(s_suppkey % 50 AS STRING), chr(9), ' ', s_name, ' ')")
    return readers.parse_names(b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), line.alias("line")))


def scan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each region, with its nations' keys."""
    path = fresh_folder(spark, "sections")
    nations = b.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("long"))).alias("song_ns"))
    rows = b.table(spark, sf_dir, "region").join(nations, "r_regionkey").select("r_regionkey", F.col("r_name").alias("title"), "song_ns")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "title", "song_ns"))), lambda x: F.struct(x["title"].alias("title"), x["song_ns"].alias("song_ns")))
    rows.agg(F.to_json(ordered).alias("value")).write.text(path)  # five regions
    return readers.sections(spark, path).select("id", "title", F.array_join(F.col("song_ns").cast("array<string>"), ",").alias("song_ns"))


SUPPRESSION = "CASE c_custkey % 4 WHEN 0 THEN concat('# ', c_name) WHEN 1 THEN concat(c_custkey % 90, ' | repeat') WHEN 2 THEN CAST(c_custkey AS STRING) ELSE concat('  ', c_custkey % 70, '|case | x ') END"


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_suppressions(b.table(spark, sf_dir, "customer").select(F.expr(SUPPRESSION).alias("line")))


def scan_git_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.versions(spark, sf_dir)
    side = lambda c: v.filter(F.col(c).isNotNull()).select("file", F.col(c).alias("text"))
    return readers.git_versions(side("old_text"), side("new_text"))


def file_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.select_files(b.song_files(spark, sf_dir), SELECTED).select("file")


def load_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under repeated numbers: the one with the largest id stays."""
    variants = F.transform("variants", lambda v: F.struct(v["label"].alias("label"), F.transform(v["body"], lambda p: F.struct(F.lit(0).alias("id"), F.lit(1).alias("n"), F.lit("verse").alias("type"), p["content"].alias("content"))).alias("body")))
    rows = b.document_songs(spark, sf_dir).select(F.expr("number div 2").alias("n"), F.col("number").alias("ordinal"), "title", variants.alias("variants"))
    loaded = store.load_replace(rows, "ordinal")
    parts = F.flatten(F.transform("variants", lambda v: v["body"]))
    return loaded.select("number", "title", F.size(parts).alias("parts"), F.size(F.filter(parts, lambda p: p["content"].isNull())).alias("nulls"))


BOOK = "conv_id // 8"
SONG = "concat(CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN concat('РАЗДЕЛ ', CAST(conv_id AS STRING), chr(10)) ELSE '' END, CASE WHEN turn = 0 THEN concat(CAST(conv_id + 1 AS STRING), '. ') ELSE '' END, CASE WHEN turn > 0 AND role = 'assistant' THEN 'Припев: ' ELSE concat(CAST(turn + 1 AS STRING), '. ') END, text)"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, text): eight conversations a book."""
    rows = b.table(spark, sf_dir, "conversations").select(F.expr("conv_id div 8").alias("book"), "conv_id", "turn", F.expr(SONG).alias("piece"))
    return rows.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "piece"))), lambda x: x["piece"]), "\n").alias("text"))


def parse_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("name"))
    return parse.parse_book(books(spark, sf_dir), names).select("book", "section", "n", "title", _shown(F.col("variants")).alias("shown"))


def names_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = parse.split_songs_in_section(parse.split_sections(books(spark, sf_dir)))
    names = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("name"))
    return songs.join(names, "n", "left").select("book", "n", title_fallback(F.col("name"), F.col("first_line")).alias("title"))


def check_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.check_contiguous(_songs(spark, sf_dir))


QUERIES = {
    "scan_text_dir": scan_text_dir,
    "scan_json_bundle": scan_json_bundle,
    "scan_tsv_names": scan_tsv_names,
    "scan_sections": scan_sections,
    "scan_suppressions": suppressions,
    "scan_git_versions": scan_git_versions,
    "file_selector": file_selector,
    "sink_json_bundle": sink_json_bundle,
    "sink_song_txt": sink_song_txt,
    "sink_song_folder": sink_song_folder,
    "load_replace": load_replace,
    "parse_header": lambda s, d: parse.parse_header(b.song_files(s, d)),
    "reject_headers": lambda s, d: parse.rejected(b.song_files(s, d)),
    "extract_meta_fields": lambda s, d: parse.meta_fields(b.song_files(s, d)),
    "split_variants": _chunks,
    "split_parts": lambda s, d: _parts(s, d).select("file", "variant", "label", "part", "type", "id", "n", "content"),
    "part_islands": lambda s, d: _parts(s, d).select("file", "variant", "part", F.size(F.split("content", "\n")).alias("n_lines")),
    "number_chorus": lambda s, d: _parts(s, d).filter("type = 'chorus'").select("file", "variant", "part", "n"),
    "number_part_ids": lambda s, d: _parts(s, d).select("file", "variant", "part", "id"),
    "concat_parts": lambda s, d: _songs(s, d).select("file", F.array_join(F.transform(F.flatten(F.col("variants.body")), lambda p: p["content"]), " ").alias("content")),
    "count_by_type": lambda s, d: _songs(s, d).select("file", F.size(F.filter(F.flatten(F.col("variants.body")), lambda p: p["type"] == "chorus")).alias("choruses"), F.size(F.filter(F.flatten(F.col("variants.body")), lambda p: p["type"] == "verse")).alias("verses")),
    "any_exists": lambda s, d: b.song_files(s, d).select("file", F.exists(F.split("text", "\n"), lambda x: F.trim(x).rlike(r"^[0-9]+\.\s")).alias("has_verse"), F.exists(F.split("text", "\n"), lambda x: F.trim(x).rlike(r"(?iu)^Припев[:.]")).alias("has_chorus")),
    "last_non_empty": lambda s, d: b.song_files(s, d).select("file", F.coalesce(F.array_max(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.trim(x) != "", i))), F.lit(0)).alias("last")),
    "assign_song_id": lambda s, d: parse.assign_song_id(b.song_files(s, d)),
    "parse_songs": lambda s, d: _songs(s, d).select("file", "id", "n", "title", _shown(F.col("variants")).alias("shown")),
    "song_to_text": lambda s, d: parse.song_to_text(_songs(s, d)),
    "check_contiguous": check_contiguous,
    "move_meta_to_end": lambda s, d: parse.move_meta_to_end(b.song_files(s, d)),
    "migrate_summary": lambda s, d: parse.migrate_summary(parse.move_meta_to_end(b.song_files(s, d))),
    "detect_sections": lambda s, d: parse.detect_sections(books(s, d)),
    "split_sections": lambda s, d: parse.split_sections(books(s, d)),
    "split_songs_in_section": lambda s, d: parse.split_songs_in_section(parse.split_sections(books(s, d))),
    "parse_book": parse_book,
    "names_left_join": names_left_join,
}
IDS = "SELECT file, CAST(n AS BIGINT) AS n, title, row_number() OVER (ORDER BY file) - 1 AS id FROM heads WHERE ok"
MOVED = {
    "mc": "SELECT file, l, coalesce(list_position(l, '@meta'), 0) AS ms, coalesce(list_position(l, '@end'), 0) AS me, coalesce(list_max(list_transform(l, lambda x, i: CASE WHEN trim(x) <> '' THEN i - 1 END)), 0) AS last, text FROM fl",
    "ms": "SELECT *, CASE WHEN ms = 0 OR me = 0 THEN 'no-meta' WHEN me - 1 >= last - 1 THEN 'already-at-end' ELSE 'moved' END AS status FROM mc",
    "mb": "SELECT *, list_slice(l, 1, ms - 1) || CASE WHEN trim(l[me + 1]) = '' THEN list_slice(l, me + 2, len(l)) ELSE list_slice(l, me + 1, len(l)) END AS body, CASE WHEN me >= ms THEN list_slice(l, ms, me) ELSE [] END AS block FROM ms",
    "mk": "SELECT *, list_slice(body, 1, coalesce(list_max(list_transform(body, lambda x, i: CASE WHEN trim(x) <> '' THEN i END)), 0)) AS kept FROM mb",
}
BOOKS = {
    "bp": f"SELECT {BOOK} AS book, conv_id, turn, {SONG} AS piece FROM conversations",
    "books": "SELECT book, string_agg(piece, chr(10) ORDER BY conv_id, turn) AS text FROM bp GROUP BY book",
    "bk": f"SELECT book, pos, raw, {TRIM.format('raw')} AS t FROM (SELECT book, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM books)",
    "bn": "SELECT *, lead(t) OVER (PARTITION BY book ORDER BY pos) AS nxt FROM bk",
    "bh": r"SELECT *, coalesce(NOT regexp_matches(t, '^\d+\.\s*\d+\.') AND NOT regexp_matches(t, '^\d+\.\s') AND NOT regexp_matches(t, '(?i)^Припев') AND NOT regexp_matches(t, '[()]') AND regexp_matches(t, '^[А-ЯA-Z]') AND regexp_matches(nxt, '^\d+\.'), false) AS head FROM bn",
    "bs": "SELECT *, sum(head::INT) OVER (PARTITION BY book ORDER BY pos) - 1 AS sid FROM bh",
    "sections": f"SELECT book, CAST(sid AS INT) AS id, max(CASE WHEN head THEN t END) AS title, coalesce({TRIM.format("string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT head)")}, '') AS text FROM bs WHERE sid >= 0 GROUP BY book, sid",
    "sl": "SELECT book, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM sections",
    "sm": r"SELECT *, regexp_extract(line, '(?i)^(\d+)\.\s*(?:\([^)\n]*\))?[ \t]+(\d+\.|Припев[:.]?)\s*([^\n]+)', 2) AS second FROM sl",
    "ss": "SELECT *, (second = '1.' OR regexp_matches(second, '(?i)^Припев')) AS start FROM sm",
    "si": "SELECT *, sum(start::INT) OVER (PARTITION BY book, id ORDER BY pos) AS song FROM ss",
    "sg": "SELECT book, id, song, max(CASE WHEN start THEN line END) AS head, string_agg(line, chr(10) ORDER BY pos) AS text FROM si WHERE song > 0 GROUP BY book, id, song",
    "songs_in": rf"SELECT book, id, song, CAST(regexp_extract(head, '^(\d+)', 1) AS BIGINT) AS n, regexp_extract(head, '(?i)^(\d+)\.\s*(?:\([^)\n]*\))?[ \t]+(\d+\.|Припев[:.]?)\s*([^\n]+)', 3) AS first_line, {TRIM.format(r"regexp_replace(" + TRIM.format("text") + r", '^\d+\.\s*', '')")} AS text FROM sg",
}
SHOWN = "SELECT file, string_agg(x, chr(10) ORDER BY variant, part) AS shown FROM (SELECT file, variant, 0 AS part, '(' || label || ')' AS x FROM chunks UNION ALL SELECT file, variant, part, concat_ws(':', type, id::VARCHAR, n::VARCHAR, content) FROM parts) GROUP BY file"
PART_TEXT = "CASE WHEN type = 'verse' THEN n::VARCHAR || '. ' || content ELSE 'Припев:' || chr(10) || content END"
ORACLE_SQL = {
    "scan_text_dir": sql(FILES, "SELECT file, text || chr(10) AS text FROM files"),
    "scan_json_bundle": steps(CHUNKS, "SELECT id, n, title, CAST(v AS INT) AS n_variants FROM ids JOIN (SELECT file, count(*) AS v FROM chunks GROUP BY file) USING (file)", ids=IDS),
    "scan_tsv_names": "SELECT s_suppkey % 50 AS n, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1",
    "scan_sections": "SELECT CAST(r_regionkey AS INT) AS id, r_name AS title, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS song_ns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "scan_suppressions": "SELECT DISTINCT lpad((CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 90 ELSE c_custkey % 70 END)::VARCHAR, 4, '0') AS file_num, CASE WHEN c_custkey % 4 = 1 THEN 'repeat' ELSE 'case' END AS \"check\" FROM customer WHERE c_custkey % 4 IN (1, 3)",
    "scan_git_versions": sql(VERSIONS, "SELECT file, old_text, new_text FROM versions WHERE old_text IS NOT NULL OR new_text IS NOT NULL"),
    "file_selector": sql(FILES, "SELECT file FROM files WHERE file IN (SELECT lpad(n::VARCHAR, 4, '0') || '.txt' FROM (SELECT unnest(generate_series(3, 20)) AS n UNION SELECT 7 UNION SELECT 42 UNION SELECT 50))"),
    "sink_json_bundle": steps(("fl", "heads"), "SELECT id, n, title FROM ids", ids=IDS),
    "load_replace": "SELECT number, title, parts, nulls FROM (SELECT doc_id // 2 AS number, string_split(coalesce(text, ''), chr(10))[1] AS title, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INT) AS parts, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x = '')) AS INT) AS nulls, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1",
    "parse_header": steps(("fl", "heads"), "SELECT file, CASE WHEN ok THEN n::BIGINT END AS n, CASE WHEN ok THEN title END AS title, ok FROM heads"),
    "reject_headers": steps(("fl", "heads"), "SELECT file, 'bad header: \"' || l[1] || '\"' AS message FROM fl JOIN heads USING (file) WHERE NOT ok"),
    "extract_meta_fields": steps(
        ("fl",), r"SELECT file, pos AS line_no, regexp_extract(t, '^(\w+):\s*(.*)$', 1) AS field, trim(regexp_extract(t, '^(\w+):\s*(.*)$', 2)) AS value FROM ml WHERE pos > ms AND pos < me AND regexp_matches(t, '^(\w+):\s*(.*)$')",
        ml="SELECT file, unnest(l) AS raw, trim(unnest(l)) AS t, CAST(generate_subscripts(l, 1) AS INT) AS pos, list_position(l, '@meta') AS ms, list_position(l, '@end') AS me FROM fl",
    ),
    "split_variants": steps(CHUNKS, "SELECT file, variant, label, content FROM chunks"),
    "split_parts": steps(PARTS, "SELECT file, variant, label, part, type, id, n, content FROM parts"),
    "part_islands": steps(PARTS, "SELECT file, variant, part, CAST(len(string_split(content, chr(10))) AS INT) AS n_lines FROM parts"),
    "number_chorus": steps(PARTS, "SELECT file, variant, part, n FROM parts WHERE type = 'chorus'"),
    "number_part_ids": steps(PARTS, "SELECT file, variant, part, id FROM parts"),
    "concat_parts": steps(PARTS, "SELECT file, coalesce(string_agg(content, ' ' ORDER BY id), '') AS content FROM heads LEFT JOIN parts USING (file) WHERE ok GROUP BY file"),
    "count_by_type": steps(PARTS, "SELECT file, CAST(count(*) FILTER (WHERE type = 'chorus') AS INT) AS choruses, CAST(count(*) FILTER (WHERE type = 'verse') AS INT) AS verses FROM heads LEFT JOIN parts USING (file) WHERE ok GROUP BY file"),
    "any_exists": steps(("fl",), r"SELECT file, len(list_filter(l, lambda x: regexp_matches(trim(x), '^\d+\.\s'))) > 0 AS has_verse, len(list_filter(l, lambda x: regexp_matches(trim(x), '(?i)^Припев[:.]'))) > 0 AS has_chorus FROM fl"),
    "last_non_empty": steps(("fl",), "SELECT file, CAST(coalesce(list_max(list_transform(l, lambda x, i: CASE WHEN trim(x) <> '' THEN i - 1 END)), 0) AS INT) AS last FROM fl"),
    "assign_song_id": steps(("fl", "heads"), "SELECT file, id FROM ids", ids=IDS),
    "parse_songs": steps(PARTS, "SELECT file, id, n, title, shown FROM ids JOIN shown USING (file)", ids=IDS, shown=SHOWN),
    "parse_book": sql(
        (), "SELECT book, id AS section, n, CASE WHEN n_name IS NOT NULL THEN n_name WHEN length(first_line) > 50 THEN substr(first_line, 1, 50) || '...' ELSE first_line END AS title, shown FROM keyed JOIN shown USING (file) LEFT JOIN nation ON n_nationkey = n",
        **BOOKS, keyed="SELECT *, book::VARCHAR || ':' || id::VARCHAR || ':' || song::VARCHAR AS file FROM songs_in", bodies="SELECT file, text AS body FROM keyed",
        **{k: STEPS[k] for k in PARTS if k not in ("fl", "heads", "bodies")}, shown=SHOWN,
    ),
    "song_to_text": steps(
        PARTS, r"SELECT n, regexp_replace('#' || n::VARCHAR || ' ' || title || chr(10) || chr(10) || string_agg(vt, '' ORDER BY variant), '\n+$', '') || chr(10) AS text FROM ids JOIN vt USING (file) GROUP BY file, n, title",
        ids=IDS, pt=f"SELECT file, variant, string_agg({PART_TEXT}, chr(10) || chr(10) ORDER BY part) AS body FROM parts GROUP BY file, variant",
        vt="SELECT c.file, c.variant, CASE WHEN label <> '' THEN '(' || label || ')' || chr(10) ELSE '' END || coalesce(body || chr(10) || chr(10), '') AS vt FROM chunks c LEFT JOIN pt USING (file, variant)",
    ),
    "check_contiguous": steps(
        PARTS, "SELECT n, problem FROM (SELECT *, min(CASE WHEN n - id <> 1 THEN id END) OVER () AS stop FROM (SELECT id, n, CASE WHEN n - id <> 1 THEN 'number' WHEN bare > 0 THEN 'empty variant' END AS problem FROM ids JOIN empties USING (file))) WHERE problem IS NOT NULL AND (stop IS NULL OR id <= stop)",
        ids=IDS, empties="SELECT c.file, count(*) FILTER (WHERE p.file IS NULL) AS bare FROM chunks c LEFT JOIN (SELECT DISTINCT file, variant FROM parts) p ON p.file = c.file AND p.variant = c.variant GROUP BY c.file",
    ),
    "move_meta_to_end": steps(("fl",), "SELECT file, status, CASE WHEN status = 'moved' THEN array_to_string(kept || [''] || block || [''], chr(10)) ELSE text END AS new_text FROM mk", **MOVED),
    "migrate_summary": steps(("fl",), "SELECT status, count(*) AS files FROM ms GROUP BY status", mc=MOVED["mc"], ms=MOVED["ms"]),
    "detect_sections": sql((), "SELECT book, CAST(pos AS INT) AS line_no, t AS title FROM bh WHERE head", **BOOKS),
    "split_sections": sql((), "SELECT book, id, title, text FROM sections", **BOOKS),
    "split_songs_in_section": sql((), "SELECT book, id, song, n, first_line, text FROM songs_in", **BOOKS),
    "names_left_join": sql((), "SELECT book, n, CASE WHEN n_name IS NOT NULL THEN n_name WHEN length(first_line) > 50 THEN substr(first_line, 1, 50) || '...' ELSE first_line END AS title FROM songs_in LEFT JOIN nation ON n_nationkey = n", **BOOKS),
}
ORACLE_SQL["sink_song_txt"] = ORACLE_SQL["song_to_text"]
#: Of songs with the same number the last one stands.
LAST = ORACLE_SQL["song_to_text"].replace(IDS, IDS + " QUALIFY row_number() OVER (PARTITION BY CAST(n AS BIGINT) ORDER BY file DESC) = 1")
ORACLE_SQL["sink_song_folder"] = f"SELECT lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') || '.txt' AS file, text FROM ({LAST})"
