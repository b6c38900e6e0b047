"""Lint and version diff bound to song texts made from ``conversations``: a query for each rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import lint, verify
from strophe.plans import bindings as b
from strophe.plans import parse_queries as p
from strophe.plans.bindings import VERSIONS, sql
from strophe.plans.text_queries import BODY, CUT, LINES_KEPT, NORM, PUNCT
from strophe.sources import readers


def _lint(rule: str):
    return lambda spark, sf_dir: lint.lint(b.song_files(spark, sf_dir), (rule,)).select("file", "line", "rule")


def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.song_files(spark, sf_dir)
    return lint.summary(files, lint.lint(files))


def next_non_empty_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint(b.song_files(spark, sf_dir), ("lint_variant_label",)).select("file", "line")


def verse_sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.verse_sequence(b.song_files(spark, sf_dir)).select("file", "variant", "n", "before")


def _suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat(conv_id, ' | ', CASE conv_id % 4 WHEN 0 THEN 'repeat' WHEN 1 THEN 'case' WHEN 2 THEN 'text' ELSE 'punctuation' END)")
    return readers.parse_suppressions(b.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(line.alias("line")))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.versions(spark, sf_dir).filter("old_text IS NOT NULL AND new_text IS NOT NULL")


def _checks(*checks: str):
    return lambda spark, sf_dir: verify.verify(b.versions(spark, sf_dir), checks).select("file", "severity", "check", "message")


def verify_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verify.suppress(verify.verify(b.versions(spark, sf_dir)), _suppressions(spark, sf_dir))
    return judged.select("file", "severity", "check", "message", "suppressed")


def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.versions(spark, sf_dir)
    return verify.summary(v, verify.suppress(verify.verify(v), _suppressions(spark, sf_dir)))


def verify_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.functions.text import extract_body

    return verify.parts(_whole(spark, sf_dir).select("file", extract_body(F.col("old_text")).alias("body"))).select("file", F.col("part").cast("long").alias("part"), "type", "n", "content")


def verify_part_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.part_zip(_whole(spark, sf_dir)).select("file", F.col("part").cast("long").alias("part"), "old_content", "new_content", "old_parts", "new_parts")


QUERIES = {
    **{rule: _lint(rule) for rule in lint.MESSAGES},
    "lint_all": lambda s, d: lint.lint(b.song_files(s, d)),
    "lint_summary": lint_summary,
    "next_non_empty_line": next_non_empty_line,
    "verse_sequence_check": verse_sequence_check,
    "verify_text": lambda s, d: verify.text_ladder(_whole(s, d)),
    "verify_parts": verify_parts,
    "verify_part_zip": verify_part_zip,
    "verify_word_diff": lambda s, d: _checks("words")(s, d),
    "verify_repeats": _checks("repeat_count", "repeat_lost", "repeat_case"),
    "lost_repeats": lambda s, d: verify.lost_repeats(_whole(s, d)),
    "distinct_repeats": lambda s, d: verify.marks(_whole(s, d)).select("file", F.array_join(F.array_distinct("old_repeats"), "|").alias("repeats")),
    "verify_chords": _checks("chord_count", "chord"),
    "verify_header": _checks("header"),
    "verify_meta": _checks("meta_absent", "meta_unclosed", "meta_unopened"),
    "verify_all": lambda s, d: verify.verify(b.versions(s, d)),
    "verify_suppress": verify_suppress,
    "verify_suppression": lambda s, d: verify_suppress(s, d).filter("suppressed").drop("suppressed"),
    "verify_skip": lambda s, d: verify.skipped(b.versions(s, d)),
    "verify_summary": verify_summary,
}

# Rules in SQL: files with the facts they need, then one condition a rule.
PART = r"regexp_matches({0}, '^\d+\.\s') OR regexp_matches({0}, '(?i)^Припев[:.]')"
FACTS = {
    "fl": p.STEPS["fl"],
    "fx": rf"""SELECT file, text, l, list_transform(l, lambda x: {p.TRIM.format('x')}) AS tl, regexp_full_match(file, '\d{{4}}\.txt') AS named, len(l) = 1 AND trim(l[1]) = '' AS bare,
      coalesce(list_position(l, '@meta'), 0) AS ms, coalesce(list_position(l, '@end'), 0) AS me, regexp_matches(l[1], '^#\d+\s+.+$') AS headed, try_cast(regexp_extract(l[1], '^#(\d+)\s+(.+)$', 1) AS BIGINT) AS hn, try_cast(regexp_extract(file, '^(\d+)', 1) AS BIGINT) AS fn FROM fl""",
    "ok": "SELECT * FROM fx WHERE named AND NOT bare",
    "el": "SELECT file, ms, me, unnest(l) AS raw, unnest(tl) AS t, generate_subscripts(l, 1) AS line FROM ok",
    "mf": r"SELECT *, CASE WHEN regexp_matches(t, '^(\w+):\s*(.*)$') THEN regexp_extract(t, '^(\w+):\s*(.*)$', 1) END AS field, regexp_extract(t, '^(\w+):\s*(.*)$', 2) AS value FROM el WHERE ms > 0 AND line > ms AND line < me",
    "mr": """SELECT file, line, CASE WHEN t = '' THEN 'lint_meta_blank_line' WHEN field IS NULL THEN 'lint_meta_syntax' WHEN field NOT IN ('meter', 'rhyme', 'note') THEN 'lint_meta_unknown_field'
      WHEN field IN ('meter', 'rhyme') AND row_number() OVER (PARTITION BY file, field ORDER BY line) > 1 THEN 'lint_meta_duplicate' WHEN trim(value) = '' THEN 'lint_meta_empty_value' END AS rule FROM mf""",
    "nl": "SELECT file, line, t, first_value(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM el",
}
RULES = {
    "lint_filename": "SELECT file, 0 AS line FROM fx WHERE NOT named",
    "lint_empty": "SELECT file, 0 AS line FROM fx WHERE named AND bare",
    "lint_header": "SELECT file, 1 AS line FROM ok WHERE NOT headed",
    "lint_number_match": "SELECT file, 1 AS line FROM ok WHERE headed AND hn <> fn",
    "lint_blank_after_header": "SELECT file, 2 AS line FROM ok WHERE len(l) > 1 AND tl[2] <> ''",
    "lint_meta_unclosed": "SELECT file, ms AS line FROM ok WHERE ms > 0 AND me = 0",
    "lint_meta_unopened": "SELECT file, me AS line FROM ok WHERE me > 0 AND ms = 0",
    "lint_meta_order": "SELECT file, unnest([ms, me]) AS line FROM ok WHERE ms > 0 AND me > 0 AND me < ms",
    "lint_meta_empty": "SELECT file, ms AS line FROM ok WHERE ms > 0 AND me = ms + 1",
    "lint_meta_position": f"SELECT file, ms AS line FROM ok WHERE ms > 0 AND me > ms AND len(list_filter(list_slice(tl, 1, ms - 1), lambda x: {PART.format('x')})) = 0",
    **{r: f"SELECT file, line FROM mr WHERE rule = '{r}'" for r in ("lint_meta_blank_line", "lint_meta_syntax", "lint_meta_unknown_field", "lint_meta_duplicate", "lint_meta_empty_value")},
    "lint_ws_only": "SELECT file, line FROM el WHERE raw <> '' AND t = ''",
    "lint_no_parts": f"SELECT file, 0 AS line FROM ok WHERE len(list_filter(list_slice(tl, CASE WHEN tl[2] = '' THEN 3 ELSE 2 END, len(tl)), lambda x: {PART.format('x')})) = 0",
    "lint_variant_label": rf"SELECT file, line FROM nl WHERE regexp_full_match(t, '\([^)]+\)') AND nxt IS NOT NULL AND NOT ({PART.format('nxt')})",
}
#: Verses of the whole body (the linter keeps meta lines in it), with their variants, in the steps of parsing.
VERSES = {k: p.STEPS[k] for k in ("fl", "bl", "near", "bound", "vl", "vn")} | {
    "bodies": "SELECT file, array_to_string(list_slice(l, CASE WHEN trim(l[2]) = '' THEN 3 ELSE 2 END, len(l)), chr(10)) AS body FROM fl",
    "vs": r"SELECT file, variant, pos, CAST(regexp_extract(t, '^\d+') AS BIGINT) AS n FROM vn WHERE NOT is_label AND regexp_matches(t, '^\d+\.\s')",
    "seq": "SELECT * FROM (SELECT file, variant, n, lag(n) OVER (PARTITION BY file, variant ORDER BY pos) AS before FROM vs) WHERE n < before OR n > before + 1",
}
VERSES = {k: VERSES[k] for k in ("fl", "bodies", "bl", "near", "bound", "vl", "vn", "vs", "seq")}
EVERY = " UNION ALL ".join(f"SELECT file, CAST(line AS INT) AS line, '{r}' AS rule FROM ({q})" for r, q in RULES.items())
SEQUENCE = r"SELECT file, 0 AS line, 'lint_verse_sequence' AS rule FROM seq WHERE regexp_full_match(file, '\d{4}\.txt')"
ALL_RULES = {**FACTS, **{k: v for k, v in VERSES.items() if k != "fl"}}
TOLD = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lint.MESSAGES.items()) + " END"
RUNG = f"CASE WHEN o = n THEN 'same' WHEN lower(o) = lower(n) THEN 'case' WHEN {PUNCT.format('o')} = {PUNCT.format('n')} THEN 'punctuation' WHEN lower({PUNCT.format('o')}) = lower({PUNCT.format('n')}) THEN 'punctuation_case' ELSE 'text' END"
V = {
    "bothv": "SELECT * FROM versions WHERE old_text IS NOT NULL AND new_text IS NOT NULL",
    "oc": CUT.format("old_text", "bothv"),
    "nc": CUT.format("new_text", "bothv"),
    "ob": f"SELECT file, {BODY} AS body FROM oc",
    "nb": f"SELECT file, {BODY} AS body FROM nc",
    "norms": f"SELECT file, {NORM.format('ob.body')} AS o, {NORM.format('nb.body')} AS n FROM ob JOIN nb USING (file)",
    "rungs": f"SELECT file, {RUNG} AS rung FROM norms",
}


def _part_steps(k: str) -> dict[str, str]:
    """Parts of the bodies ``{k}b`` of the diff: blank lines and bare labels close them."""
    start = rf"regexp_matches(t, '^\d+(\([а-яё]+\))?\.\s') OR regexp_matches(t, '(?i)^Припев[:.]')"
    return {
        f"{k}l": f"SELECT file, pos, {p.TRIM.format('raw')} AS t FROM (SELECT file, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM {k}b)",
        f"{k}f": rf"SELECT *, t = '' OR regexp_full_match(t, '\([^)]+\)') AS close, {start} AS start FROM {k}l",
        f"{k}i": f"SELECT *, sum((close OR start)::INT) OVER (PARTITION BY file ORDER BY pos) AS island FROM {k}f",
        f"{k}g": rf"SELECT file, island, max(CASE WHEN start THEN t END) AS head, {p.TRIM.format('string_agg(t, chr(10) ORDER BY pos)')} AS content FROM {k}i GROUP BY file, island HAVING bool_or(start)",
        f"{k}p": rf"SELECT file, row_number() OVER (PARTITION BY file ORDER BY island) - 1 AS part, CASE WHEN regexp_matches(head, '^\d+(\([а-яё]+\))?\.\s') THEN 'verse' ELSE 'chorus' END AS type, CASE WHEN regexp_matches(head, '^\d+(\([а-яё]+\))?\.\s') THEN CAST(regexp_extract(head, '^\d+') AS BIGINT) ELSE 0 END AS n, content FROM {k}g WHERE content <> ''",
    }


PV = {**V, **_part_steps("o"), **_part_steps("n")}
PV["zip"] = "SELECT file, part, o.type, o.n, o.content AS old_content, n.content AS new_content, count(o.type) OVER (PARTITION BY file) AS old_parts, count(n.type) OVER (PARTITION BY file) AS new_parts FROM op o FULL JOIN np n USING (file, part)"


def _bare(k: str) -> str:
    return rf"SELECT file, regexp_replace(array_to_string({LINES_KEPT}, chr(10)), '\[[^\]]*\]', '', 'g') AS t FROM {k}c"


def _found(k: str) -> str:
    flat = r"regexp_replace(t, '\s+', ' ', 'g')"
    first = rf"list_transform(regexp_extract_all({flat}, '/[^/]*?/\s*\d+\s*р\.?'), lambda x: {NORM.format('x')})"
    second = rf"list_transform(regexp_extract_all({flat}, '/[^/]+?\s*/\s*\d+\s*р\.?'), lambda x: {NORM.format('x')})"
    return rf"SELECT file, list_sort(m1 || list_filter(list_distinct(m2), lambda r: NOT list_contains(m1, r))) AS reps, chords FROM (SELECT file, {first} AS m1, {second} AS m2, regexp_extract_all(t, '\{{[^}}]+\}}') AS chords FROM {k}bare)"


M = {"bothv": V["bothv"], "oc": V["oc"], "nc": V["nc"], "obare": _bare("o"), "nbare": _bare("n"), "om": _found("o"), "nm": _found("n")}
M["lost"] = "SELECT o.file, o.r AS repeat, CASE WHEN len(list_filter(nm.reps, lambda x: lower(x) = lower(o.r))) > 0 THEN 'warning' ELSE 'error' END AS severity FROM (SELECT file, unnest(reps) AS r FROM om) o JOIN nm ON nm.file = o.file WHERE NOT list_contains(nm.reps, o.r)"
_COUNTS = "SELECT om.file, 'error' AS severity, '{0}_count' AS \"check\", '{0}s: ' || len(om.{1})::VARCHAR || ' before, ' || len(nm.{1})::VARCHAR || ' now' AS message FROM om JOIN nm USING (file) WHERE len(om.{1}) <> len(nm.{1})"
F_REPEATS = _COUNTS.format("repeat", "reps") + " UNION ALL SELECT file, severity, CASE severity WHEN 'error' THEN 'repeat_lost' ELSE 'repeat_case' END, CASE severity WHEN 'error' THEN 'repeat lost: \"' ELSE 'case changed in repeat: \"' END || repeat || '\"' FROM lost"
F_CHORDS = _COUNTS.format("chord", "chords") + " UNION ALL SELECT file, 'error', 'chord', 'chord changed: \"' || a || '\" → \"' || z || '\"' FROM (SELECT om.file, unnest(list_slice(om.chords, 1, least(len(om.chords), len(nm.chords)))) AS a, unnest(list_slice(nm.chords, 1, least(len(om.chords), len(nm.chords)))) AS z FROM om JOIN nm USING (file)) WHERE a <> z"
F_HEADER = r"""SELECT file, 'error' AS severity, 'header' AS "check", 'header number: #' || a || ' → #' || z AS message FROM (SELECT file, regexp_extract(old_text, '^#(\d+)', 1) AS a, regexp_extract(new_text, '^#(\d+)', 1) AS z FROM bothv) WHERE a <> '' AND z <> '' AND a <> z"""
F_META = "SELECT file, CASE WHEN ms = 0 AND me = 0 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN ms = 0 AND me = 0 THEN 'meta_absent' WHEN me = 0 THEN 'meta_unclosed' ELSE 'meta_unopened' END AS \"check\", CASE WHEN ms = 0 AND me = 0 THEN 'no meta block' WHEN me = 0 THEN '@meta without @end' ELSE '@end without @meta' END AS message FROM nc WHERE ms = 0 OR me = 0"
_KIND = "CASE rung WHEN 'case' THEN 'case changed' WHEN 'punctuation' THEN 'space before punctuation removed' ELSE 'space before punctuation removed and case changed' END"
_MILD = "rung IN ('case', 'punctuation', 'punctuation_case')"
_WORDS = """list_filter(list_transform(range(0, greatest(len(a), len(z))), lambda i: CASE WHEN a[i + 1] IS DISTINCT FROM z[i + 1] THEN '[' || i::VARCHAR || ']: "' || coalesce(nullif(a[i + 1], ''), '∅') || '" → "' || coalesce(nullif(z[i + 1], ''), '∅') || '"' END), lambda x: x IS NOT NULL)"""
#: Differences of the parts of files whose texts differ, and all findings of the diff.
T = {
    "pairs": f"SELECT file, part, type || ' ' || n::VARCHAR AS place, old_parts, new_parts, {NORM.format('old_content')} AS o, {NORM.format('new_content')} AS n FROM zip WHERE file IN (SELECT file FROM rungs WHERE rung = 'text')",
    "even": f"SELECT file, place, o, n, {RUNG} AS rung FROM pairs WHERE old_parts = new_parts",
    "words": f"SELECT file, {_WORDS} AS d FROM (SELECT file, string_split(o, ' ') AS a, string_split(n, ' ') AS z FROM even WHERE rung = 'text')",
    "totals": "SELECT file, max(old_parts) AS op, max(new_parts) AS np, coalesce(string_agg(o, ' ' ORDER BY part), '') AS o, coalesce(string_agg(n, ' ' ORDER BY part), '') AS n FROM pairs WHERE old_parts <> new_parts GROUP BY file",
    "uneven": f"SELECT file, op, np, {RUNG} AS rung FROM totals",
}
F_WORDS = "SELECT file, 'error' AS severity, 'words' AS \"check\", CASE WHEN len(d) <= 5 THEN array_to_string(d, ', ') ELSE len(d)::VARCHAR || ' differences, first: ' || d[1] END AS message FROM words"
F_TEXT = f"""SELECT file, 'warning' AS severity, rung AS "check", {_KIND} AS message FROM rungs WHERE {_MILD}
  UNION ALL SELECT file, 'warning', rung, {_KIND} || ' in ' || place FROM even WHERE {_MILD}
  UNION ALL SELECT file, 'error', 'text', 'text changed in ' || place FROM even WHERE rung = 'text' UNION ALL {F_WORDS}
  UNION ALL SELECT file, 'error', 'part_count', 'parts: ' || op::VARCHAR || ' before, ' || np::VARCHAR || ' now' FROM uneven
  UNION ALL SELECT file, CASE rung WHEN 'text' THEN 'error' ELSE 'warning' END, CASE rung WHEN 'text' THEN 'whole_text' WHEN 'case' THEN 'case' ELSE 'punctuation' END,
    CASE rung WHEN 'text' THEN 'whole text differs: lost or distorted' WHEN 'case' THEN 'case changed in the whole text' ELSE 'space before punctuation removed in the whole text' END FROM uneven WHERE rung <> 'same'"""
ALL = {**PV, **T, **M, "findings": " UNION ALL ".join((F_TEXT, F_REPEATS, F_CHORDS, F_HEADER, F_META))}
JUDGED = ALL | {
    "kinds": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, v in verify.SUPPRESSES.items() for c in v) + ') t("by", "check")',
    "wanted": """SELECT DISTINCT lpad(conv_id::VARCHAR, CAST(greatest(4, length(conv_id::VARCHAR)) AS INT), '0') || '.txt' AS file, kinds."check" FROM conversations JOIN kinds
      ON "by" = CASE conv_id % 4 WHEN 0 THEN 'repeat' WHEN 1 THEN 'case' WHEN 2 THEN 'text' ELSE 'punctuation' END""",
    "judged": 'SELECT f.*, w.file IS NOT NULL AS suppressed FROM findings f LEFT JOIN wanted w ON w.file = f.file AND w."check" = f."check"',
}
TOTALS = """SELECT CAST(sum(whole::INT) AS BIGINT) AS checked, CAST(sum((NOT whole)::INT) AS BIGINT) AS skipped, CAST(sum(s) AS BIGINT) AS suppressed, CAST(sum(e) AS BIGINT) AS errors, CAST(sum((e > 0)::INT) AS BIGINT) AS files_with_errors,
  CAST(sum(CASE WHEN e = 0 THEN w ELSE 0 END) AS BIGINT) AS warnings, CAST(sum((e = 0 AND w > 0)::INT) AS BIGINT) AS files_with_warnings FROM
  (SELECT v.file, old_text IS NOT NULL AND new_text IS NOT NULL AS whole, coalesce(e, 0) AS e, coalesce(w, 0) AS w, coalesce(s, 0) AS s FROM versions v LEFT JOIN
  (SELECT file, count(*) FILTER (WHERE NOT suppressed AND severity = 'error') AS e, count(*) FILTER (WHERE NOT suppressed AND severity = 'warning') AS w, count(*) FILTER (WHERE suppressed) AS s FROM judged GROUP BY file) j ON j.file = v.file)"""
ORACLE_SQL = {
    **{r: sql(b.FILES, f"SELECT file, CAST(line AS INT) AS line, '{r}' AS rule FROM ({q})", **FACTS) for r, q in RULES.items()},
    "lint_verse_sequence": sql(b.FILES, SEQUENCE, **VERSES),
    "lint_all": sql(b.FILES, f"SELECT file, line, rule, {TOLD} AS message FROM ({EVERY} UNION ALL {SEQUENCE})", **ALL_RULES),
    "lint_summary": sql(
        b.FILES, "SELECT count(*) AS files, count(n) AS files_with_errors, count(*) - count(n) AS ok_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS errors FROM files LEFT JOIN (SELECT file, count(*) AS n FROM every_rule GROUP BY file) USING (file)",
        **ALL_RULES, every_rule=f"{EVERY} UNION ALL {SEQUENCE}",
    ),
    "next_non_empty_line": sql(b.FILES, f"SELECT file, CAST(line AS INT) AS line FROM ({RULES['lint_variant_label']})", **FACTS),
    "verse_sequence_check": sql(b.FILES, "SELECT file, variant, n, before FROM seq", **VERSES),
    "verify_text": sql(VERSIONS, "SELECT file, rung FROM rungs", **V),
    "verify_parts": sql(VERSIONS, "SELECT file, part, type, n, content FROM op", **PV),
    "verify_part_zip": sql(VERSIONS, "SELECT file, part, old_content, new_content, old_parts, new_parts FROM zip", **PV),
    "lost_repeats": sql(VERSIONS, "SELECT file, repeat, severity FROM lost", **M),
    "distinct_repeats": sql(VERSIONS, "SELECT file, array_to_string(list_sort(list_distinct(reps)), '|') AS repeats FROM om", **M),
    "verify_repeats": sql(VERSIONS, F_REPEATS, **M),
    "verify_chords": sql(VERSIONS, F_CHORDS, **M),
    "verify_header": sql(VERSIONS, F_HEADER, bothv=V["bothv"]),
    "verify_meta": sql(VERSIONS, F_META, bothv=V["bothv"], nc=V["nc"]),
    "verify_word_diff": sql(VERSIONS, F_WORDS, **PV, **T),
    "verify_all": sql(VERSIONS, 'SELECT file, severity, "check", message FROM findings', **ALL),
    "verify_suppress": sql(VERSIONS, 'SELECT file, severity, "check", message, suppressed FROM judged', **JUDGED),
    "verify_suppression": sql(VERSIONS, 'SELECT file, severity, "check", message FROM judged WHERE suppressed', **JUDGED),
    "verify_summary": sql(VERSIONS, TOTALS, **JUDGED),
    "verify_skip": sql(VERSIONS, "SELECT file, CASE WHEN new_text IS NULL THEN 'file not found' ELSE 'no old version' END AS reason FROM versions WHERE new_text IS NULL OR old_text IS NULL"),
}
