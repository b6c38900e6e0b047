"""Scalar text operators bound to ``documents``, ``conversations``, ``events`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import markup, text
from strophe.operators import search
from strophe.plans import bindings as b
from strophe.plans.bindings import DOCS, FILES, VERSIONS, sql

CLEAN = r"""trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[/\[\]()!?.,;:"''-]', ' ', 'g'), '\s+', ' ', 'g'))"""
NORM = r"trim(regexp_replace(regexp_replace({0}, '\[[^\]]*\]', '', 'g'), '\s+', ' ', 'g'))"
PUNCT = r"regexp_replace(regexp_replace({0}, ' +([!?.,;:)\]])', '\1', 'g'), '([!?.,;:)])([А-ЯЁA-Zа-яёa-z])', '\1 \2', 'g')"
#: Lines of a text, and the places of the meta lines.
CUT = "SELECT file, {0} AS text, string_split({0}, chr(10)) AS l, coalesce(list_position(string_split({0}, chr(10)), '@meta'), 0) AS ms, coalesce(list_position(string_split({0}, chr(10)), '@end'), 0) AS me FROM {1}"
LINES_KEPT = "CASE WHEN ms > 0 AND me > ms THEN list_filter(l, lambda x, i: i < ms OR i > me) ELSE l END"
SKIP = r"CASE WHEN regexp_matches(l[1], '^#[0-9]+') THEN CASE WHEN trim(l[2]) = '' THEN 2 ELSE 1 END ELSE 0 END"
BODY = rf"CASE WHEN ms > 0 AND me > ms THEN regexp_replace(regexp_replace(array_to_string(list_slice({LINES_KEPT}, {SKIP} + 1, len(l)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE array_to_string(list_slice(l, {SKIP} + 1, len(l)), chr(10)) END"
SHIFTED = "replace(text, ', ', ' ,')"
TOKENS = r"regexp_extract_all({0}, '//|/\s*\d+\s*р\s*\.?|/|[^/]+')"


def _column(source: str, key: str, name: str, f, column: str = "text"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return b.table(spark, sf_dir, source).select(key, f(F.col(column)).alias(name))

    return query


def _of_files(name: str, f):
    return lambda spark, sf_dir: b.song_files(spark, sf_dir).select("file", f(F.col("text")).alias(name))


def _repeats(x: Column) -> Column:
    return text.extract_repeats(text.strip_stage_directions(text.strip_meta_lines(x)))


def _tokens(x: Column) -> Column:
    shown = lambda t: F.when(t["type"] == "text", F.concat(F.lit("t:"), t["value"])).when(t["type"] == "close", F.concat(F.lit("c:"), t["count"])).otherwise("o")
    return F.array_join(F.transform(text.tokenize_repeats(x), shown), "|")


def has_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.song_files(spark, sf_dir).select("file", text.has_chords(F.col("text")).alias("shown"), text.has_chords(F.col("text"), False).alias("hidden"))


def query_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a query: what is left of it, and whether it is long enough."""
    q = F.lower(text.clean_text(F.col("text")))
    return b.table(spark, sf_dir, "documents").select("doc_id", q.alias("query"), (F.length(q) >= search.MIN_QUERY).alias("passes"))


def parse_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.expr("CASE order_id % 5 WHEN 0 THEN concat(':', order_id) WHEN 1 THEN CAST(order_id AS STRING) WHEN 2 THEN concat(order_id, ':x') ELSE concat(order_id, ':', order_id % 7) END")
    rows = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id")).select("order_id", text.parse_ref(ref).alias("r"))
    return rows.select("order_id", "r.n", "r.variantIndex")


def is_number_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(' ', doc_id, ' ') WHEN 1 THEN concat(doc_id, 'a') ELSE text END")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.is_number_query(q), F.lit(False)).alias("is_number"))


def variant_tab_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.document_songs(spark, sf_dir).select("number", F.posexplode("variants").alias("variantIndex", "v"))
    return rows.select("number", "variantIndex", text.variant_tab_label(F.col("v.label"), F.col("variantIndex")).alias("label"))


def variant_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the variants that have lines; asked for places 0 to 2."""
    some = F.filter("variants", lambda v: F.size(v["body"]) > 0)
    rows = b.document_songs(spark, sf_dir).select("number", some.alias("variants"), F.explode(F.array(*map(F.lit, range(3)))).alias("place"))
    return rows.select("number", "place", text.variant_label_lookup(F.col("variants"), F.col("place")).alias("label"))


def pluralize_ru(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 130
    words = ("песня", "песни", "песен")
    return b.table(spark, sf_dir, "orders").select("o_orderkey", text.pluralize_ru(n, *words).alias("shown"), text.pluralize_ru(n, *words, empty_zero=False).alias("linted"))


def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('name ', doc_id) END")
    return b.table(spark, sf_dir, "documents").select("doc_id", text.title_fallback(name, F.split("text", "\n")[0]).alias("title"))


def parse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.parse_repeats(b.table(spark, sf_dir, "pages"), "page_id", "html")


QUERIES = {
    "clean_text": _column("documents", "doc_id", "cleaned", text.clean_text),
    "flatten_text": _column("documents", "doc_id", "flat", text.flatten_text),
    "strip_stage_directions": _of_files("stripped", text.strip_stage_directions),
    "normalize_ws": _of_files("normalized", text.normalize_ws),
    "normalize_punct": _column("documents", "doc_id", "normalized", lambda x: text.normalize_punct(F.replace(x, F.lit(", "), F.lit(" ,")))),
    "extract_body": lambda s, d: b.versions(s, d).select("file", text.extract_body(F.col("old_text")).alias("old_body"), text.extract_body(F.col("new_text")).alias("new_body")),
    "extract_repeats": _of_files("repeats", lambda x: F.array_join(_repeats(x), "|")),
    "extract_chords": _column("events", "event_id", "chords", lambda x: F.array_join(text.extract_chords(x), "|"), "props"),
    "tokenize_repeats": _column("pages", "page_id", "tokens", _tokens, "html"),
    "strip_repeats": _column("pages", "page_id", "stripped", text.strip_repeats, "html"),
    "strip_meta": _of_files("stripped", text.strip_meta),
    "strip_meta_lines": _of_files("stripped", text.strip_meta_lines),
    "has_chords": has_chords,
    "query_gate": query_gate,
    "parse_ref": parse_ref,
    "is_number_query": is_number_query,
    "variant_tab_label": variant_tab_label,
    "variant_label_lookup": variant_label_lookup,
    "pluralize_ru": pluralize_ru,
    "title_fallback": title_fallback,
    "parse_repeats": parse_repeats,
    "render_repeats": lambda s, d: markup.render_repeats(b.table(s, d, "pages"), "page_id", "html"),
    "render_content": lambda s, d: markup.render_content(b.song_files(s, d), "file", "text"),
}


def _marks_sql(source: str, key: str, column: str) -> dict[str, str]:
    """Every mark with its partner: running depths, and the next mark of the same depth."""
    return {
        "cut": f"SELECT {key} AS k, {TOKENS.format(f'coalesce({column}, {chr(39) * 2})')} AS parts FROM {source}",
        "single": "SELECT k, flatten(list_transform(parts, lambda x: CASE WHEN x = '//' THEN ['/', '/'] ELSE [x] END)) AS parts FROM cut",
        "tokens": r"SELECT k, generate_subscripts(parts, 1) AS pos, unnest(parts) AS x FROM single",
        "typed": r"SELECT *, CASE WHEN x = '/' THEN 1 WHEN regexp_full_match(x, '/\s*\d+\s*р\s*\.?') THEN -1 ELSE 0 END AS step, regexp_extract(x, '\d+') AS num FROM tokens",
        "summed": "SELECT *, sum(step) OVER (PARTITION BY k ORDER BY pos)::BIGINT AS s FROM typed",
        "floored": "SELECT *, least(0, min(s) OVER (PARTITION BY k ORDER BY pos)) AS low FROM summed",
        "deep": "SELECT *, s - low AS d, step = -1 AND low < coalesce(lag(low) OVER (PARTITION BY k ORDER BY pos), 0) AS lost FROM floored",
        "told": "SELECT *, lost OR (step = 1 AND min(d) OVER (PARTITION BY k ORDER BY pos DESC) = d) AS lone, CASE WHEN step = 1 THEN d - 1 ELSE d END AS lv FROM deep",
        "marks": """SELECT *, CASE WHEN lone THEN 0 ELSE lv - sum(CASE WHEN lone AND step = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) END::INT AS depth,
          CASE WHEN NOT lone AND step <> 0 THEN lead(num) OVER (PARTITION BY k, step <> 0 AND NOT lone, lv ORDER BY pos) END AS times,
          CASE WHEN step = 0 THEN x WHEN lone AND step = 1 THEN '/' WHEN lone THEN '/' || num || 'р.' END AS value FROM told""",
        "html": """SELECT k, string_agg(CASE WHEN value IS NOT NULL THEN replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
          WHEN step = 1 THEN '<span class="repeat-marker">/</span><span class="repeat' || CASE WHEN depth > 0 THEN ' repeat-depth-' || least(depth, 3)::VARCHAR ELSE '' END || '">'
          ELSE '</span><span class="repeat-marker">/' || num || 'р.</span>' END, '' ORDER BY pos) AS html FROM marks GROUP BY k""",
    }


RENDERED = r"""replace(regexp_replace(replace(replace(replace(coalesce(html, ''), '{_', '<span class=''chord''>'), '{', '<span class=''chord chord-up''>'), '}', '</span>'), '\[([^\]]*)\]', '<span class=''stage-direction''>\1</span>', 'g'), chr(10), '<br/>')"""
PLURAL = "CASE WHEN n % 100 > 10 AND n % 100 < 20 THEN 'песен' WHEN n % 10 IN (2, 3, 4) THEN 'песни' WHEN n % 10 = 1 THEN 'песня' ELSE 'песен' END"
ORACLE_SQL = {
    "clean_text": f"SELECT doc_id, {CLEAN.format('text')} AS cleaned FROM documents",
    "flatten_text": rf"SELECT doc_id, regexp_replace(lower({CLEAN.format('text')}), '\s+', '', 'g') AS flat FROM documents",
    "strip_stage_directions": sql(FILES, r"SELECT file, regexp_replace(text, '\[[^\]]*\]', '', 'g') AS stripped FROM files"),
    "normalize_ws": sql(FILES, f"SELECT file, {NORM.format('text')} AS normalized FROM files"),
    "normalize_punct": f"SELECT doc_id, {PUNCT.format(SHIFTED)} AS normalized FROM documents",
    "extract_body": sql(VERSIONS, f"SELECT o.file, o.body AS old_body, n.body AS new_body FROM (SELECT file, {BODY} AS body FROM o) o JOIN (SELECT file, {BODY} AS body FROM n) n USING (file)", o=CUT.format("old_text", "versions"), n=CUT.format("new_text", "versions")),
    "extract_repeats": sql(
        FILES,
        "SELECT file, array_to_string(list_sort(m1 || list_filter(list_distinct(m2), lambda r: NOT list_contains(m1, r))), '|') AS repeats FROM found",
        cut=CUT.format("text", "files"),
        bare=rf"SELECT file, regexp_replace(regexp_replace(array_to_string({LINES_KEPT}, chr(10)), '\[[^\]]*\]', '', 'g'), '\s+', ' ', 'g') AS t FROM cut",
        found=rf"SELECT file, list_transform(regexp_extract_all(t, '/[^/]*?/\s*\d+\s*р\.?'), lambda x: {NORM.format('x')}) AS m1, list_transform(regexp_extract_all(t, '/[^/]+?\s*/\s*\d+\s*р\.?'), lambda x: {NORM.format('x')}) AS m2 FROM bare",
    ),
    "extract_chords": r"SELECT event_id, array_to_string(regexp_extract_all(props, '\{[^}]+\}'), '|') AS chords FROM events",
    "tokenize_repeats": rf"SELECT page_id, array_to_string(list_transform({TOKENS.format('html')}, lambda x: CASE WHEN x = '//' THEN 'o|o' WHEN x = '/' THEN 'o' WHEN regexp_full_match(x, '/\s*\d+\s*р\s*\.?') THEN 'c:' || regexp_extract(x, '\d+') ELSE 't:' || x END), '|') AS tokens FROM pages",
    "strip_repeats": rf"SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN '' WHEN contains(html, '/') THEN trim(regexp_replace(array_to_string(list_filter({TOKENS.format('html')}, lambda x: NOT starts_with(x, '/')), ''), '\s+', ' ', 'g')) ELSE html END AS stripped FROM pages",
    "strip_meta": sql(FILES, r"SELECT file, regexp_replace(text, '@meta\n[\s\S]*?\n@end\n?', '') AS stripped FROM files"),
    "strip_meta_lines": sql(FILES, f"SELECT file, array_to_string({LINES_KEPT}, chr(10)) AS stripped FROM cut", cut=CUT.format("text", "files")),
    "has_chords": sql(FILES, "SELECT file, contains(text, '{') AS shown, false AS hidden FROM files"),
    "query_gate": f"SELECT doc_id, query, length(query) >= 3 AS passes FROM (SELECT doc_id, lower({CLEAN.format('text')}) AS query FROM documents)",
    "parse_ref": "SELECT o_orderkey AS order_id, CASE o_orderkey % 5 WHEN 0 THEN ':' || o_orderkey::VARCHAR ELSE o_orderkey::VARCHAR END AS n, CAST(CASE WHEN o_orderkey % 5 IN (3, 4) THEN o_orderkey % 7 ELSE 0 END AS INT) AS variantIndex FROM orders",
    "is_number_query": r"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE coalesce(regexp_matches(trim(text), '^[0-9]+$'), false) END AS is_number FROM documents",
    "variant_tab_label": "SELECT doc_id AS number, v::INT AS variantIndex, CASE WHEN v = 1 THEN 'б' ELSE 'а' END AS label FROM documents, (VALUES (0), (1)) t(v)",
    "variant_label_lookup": "SELECT doc_id AS number, k::INT AS place, CASE WHEN k = 1 AND contains(coalesce(text, ''), chr(10)) THEN 'б' ELSE '' END AS label FROM documents, (VALUES (0), (1), (2)) t(k)",
    "pluralize_ru": f"SELECT o_orderkey, CASE WHEN n = 0 THEN '' ELSE {PLURAL} END AS shown, {PLURAL} AS linted FROM (SELECT o_orderkey, o_orderkey % 130 AS n FROM orders)",
    "title_fallback": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'name ' || doc_id::VARCHAR WHEN length(f) > 50 THEN substr(f, 1, 50) || '...' ELSE f END AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS f FROM documents)",
    "parse_repeats": sql((), "SELECT k AS page_id, (row_number() OVER (PARTITION BY k ORDER BY pos) - 1)::INT AS at, depth, CASE WHEN step = 1 AND NOT lone THEN 'repeat' ELSE 'text' END AS type, value, CASE WHEN step = 1 THEN times END AS count FROM marks WHERE lone OR step >= 0", **_marks_sql("pages", "page_id", "html")),
    "render_repeats": sql((), "SELECT page_id, coalesce(h.html, '') AS html FROM pages LEFT JOIN html h ON k = page_id", **_marks_sql("pages", "page_id", "html")),
    "render_content": sql(FILES, f"SELECT file, {RENDERED} AS html FROM files LEFT JOIN html ON k = file", **_marks_sql("files", "file", "text")),
}
