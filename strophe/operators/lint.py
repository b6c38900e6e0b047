"""Format rules as violation rows: (file, line, rule, message), line 0 for the whole file.

Texts are exploded into lines once; all line rules read that one frame, whose windows run inside a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import lines, strip_space
from strophe.operators.parse import HEADER, split_variants

VERSE = r"^[0-9]+\.\s"
CHORUS = r"(?iu)^Припев[:.]"
FILE_NAME = r"^([0-9]{4})\.txt\z"
#: Meta fields, and whether each may repeat.
META_FIELDS = {"meter": False, "rhyme": False, "note": True}
MESSAGES = {
    "lint_filename": "file name must be NNNN.txt",
    "lint_empty": "file is empty",
    "lint_header": "header must be #N Title",
    "lint_number_match": "header number differs from file number",
    "lint_blank_after_header": "a blank line must follow the header",
    "lint_meta_unclosed": "@meta without @end",
    "lint_meta_unopened": "@end without @meta",
    "lint_meta_order": "@end before @meta",
    "lint_meta_empty": "meta block is empty",
    "lint_meta_position": "@meta must follow a verse or chorus",
    "lint_meta_blank_line": "blank line in the meta block",
    "lint_meta_syntax": "meta line must be field: value",
    "lint_meta_unknown_field": "unknown meta field",
    "lint_meta_duplicate": "meta field repeats",
    "lint_meta_empty_value": "meta field is empty",
    "lint_ws_only": "line has white space only",
    "lint_no_parts": "no verse and no chorus",
    "lint_verse_sequence": "verse numbers fall or skip",
    "lint_variant_label": "variant label before no verse or chorus",
}


def _line(all_lines: Column, k: int) -> Column:
    return F.get(all_lines, F.lit(k))


def _is_part(x: Column) -> Column:
    return x.rlike(VERSE) | x.rlike(CHORUS)


#: Rules by what they look at.
FILE_RULES = tuple(r for r in MESSAGES if r in ("lint_filename", "lint_empty", "lint_header", "lint_number_match", "lint_blank_after_header", "lint_no_parts") or r.startswith("lint_meta_") and r.rsplit("_", 1)[1] in ("unclosed", "unopened", "order", "empty", "position"))
META_RULES = tuple(r for r in MESSAGES if r.startswith("lint_meta_") and r not in FILE_RULES)


def _file_rules(files: DataFrame, rules: tuple[str, ...] = FILE_RULES) -> DataFrame:
    """Rules that look at a file as a whole: an array of (line, rule), exploded; no shuffle."""
    rows = files.select("file", "text", lines(F.col("text")).alias("l")).withColumns({"start": F.array_position("l", "@meta").cast("int"), "end": F.array_position("l", "@end").cast("int")})
    rows = rows.withColumn("t", F.transform("l", strip_space))
    start, end, t = F.col("start"), F.col("end"), F.col("t")
    named = F.col("file").rlike(FILE_NAME)
    empty = (F.size("l") == 1) & (_line(t, 0) == "")
    headed = _line(F.col("l"), 0).rlike(HEADER)
    number = F.regexp_extract(_line(F.col("l"), 0), HEADER, 1).try_cast("long")
    second = F.coalesce(_line(t, 1) == "", F.lit(False))
    body = F.slice(t, F.when(second, 3).otherwise(2), F.size(t))
    ordered = (start > 0) & (end > start)
    before = F.slice("l", F.lit(1), F.greatest(start - 1, F.lit(0)))

    def hit(rule: str, line: Column | int, when: Column) -> Column:
        one = F.struct((line if isinstance(line, Column) else F.lit(line)).cast("int").alias("line"), F.lit(rule).alias("rule"))
        return F.when(F.coalesce(when, F.lit(False)) if rule in rules else F.lit(False), one)

    rest = [
        hit("lint_header", 1, ~headed),
        hit("lint_number_match", 1, headed & (number != F.regexp_extract("file", FILE_NAME, 1).try_cast("long"))),
        hit("lint_blank_after_header", 2, (F.size("l") > 1) & ~second),
        hit("lint_meta_unclosed", start, (start > 0) & (end == 0)),
        hit("lint_meta_unopened", end, (start == 0) & (end > 0)),
        hit("lint_meta_order", end, (start > 0) & (end > 0) & (end < start)),
        hit("lint_meta_order", start, (start > 0) & (end > 0) & (end < start)),
        hit("lint_meta_empty", start, ordered & (end == start + 1)),
        hit("lint_meta_position", start, ordered & ~F.exists(before, _is_part)),
        hit("lint_no_parts", 0, ~F.exists(body, _is_part)),
    ]
    found = F.when(~named, F.array(hit("lint_filename", 0, F.lit(True)))).when(empty, F.array(hit("lint_empty", 0, F.lit(True)))).otherwise(F.array(*rest))
    return rows.select("file", F.explode(F.array_compact(found)).alias("v")).select("file", "v.line", "v.rule")


def _checked(files: DataFrame) -> DataFrame:
    """Files that later rules look at: well named and not empty."""
    return files.filter(F.col("file").rlike(FILE_NAME) & ~((F.instr("text", "\n") == 0) & (strip_space(F.col("text")) == "")))


def _lines(files: DataFrame) -> DataFrame:
    return _checked(files).select("file", F.posexplode(lines(F.col("text"))).alias("pos", "raw")).withColumns({"line": F.col("pos") + 1, "t": strip_space(F.col("raw"))}).drop("pos")


def _meta_rules(every: DataFrame) -> DataFrame:
    w = W.partitionBy("file")
    marked = every.withColumns({"start": F.min(F.when(F.col("raw") == "@meta", F.col("line"))).over(w), "end": F.min(F.when(F.col("raw") == "@end", F.col("line"))).over(w)})
    field = r"^([A-Za-z0-9_]+):\s*(.*)\z"
    name = F.when(F.col("t").rlike(field), F.regexp_extract("t", field, 1))
    inside = marked.filter((F.col("line") > F.col("start")) & (F.col("line") < F.col("end"))).withColumns({"field": name, "value": strip_space(F.regexp_extract("t", field, 2))})
    single = [k for k, many in META_FIELDS.items() if not many]
    again = F.col("field").isin(*single) & (F.row_number().over(W.partitionBy("file", "field").orderBy("line")) > 1)
    rule = (
        F.when(F.col("t") == "", "lint_meta_blank_line")
        .when(F.col("field").isNull(), "lint_meta_syntax")
        .when(~F.col("field").isin(*META_FIELDS), "lint_meta_unknown_field")
        .when(again, "lint_meta_duplicate")
        .when(F.col("value") == "", "lint_meta_empty_value")
    )
    return inside.select("file", "line", rule.alias("rule")).filter(F.col("rule").isNotNull())


def _label_rules(every: DataFrame) -> DataFrame:
    after = W.partitionBy("file").orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1)  # from the end: one pass
    following = F.last(F.when(F.col("t") != "", F.col("t")), ignorenulls=True).over(after)
    rows = every.select("file", "line", "t", following.alias("following")).filter(F.col("t").rlike(r"^\([^)]+\)\z"))
    return rows.filter(F.col("following").isNotNull() & ~_is_part(F.col("following"))).select("file", "line", F.lit("lint_variant_label").alias("rule"))


def verse_sequence(files: DataFrame) -> DataFrame:
    """(file, variant, label, n, before): verses whose number falls, or skips, after the verse before."""
    every = lines(F.col("text"))
    second = F.coalesce(strip_space(F.get(every, F.lit(1))) == "", F.lit(False))
    body = F.array_join(F.slice(every, F.when(second, 3).otherwise(2), F.size(every)), "\n")
    chunks = split_variants(files.select("file", body.alias("body")), ["file"])
    rows = chunks.select("file", "variant", "label", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line", strip_space(F.col("line"))).filter(F.col("line").rlike(VERSE))
    numbered = rows.withColumn("n", F.regexp_extract("line", r"^([0-9]+)", 1).try_cast("long"))
    lagged = numbered.withColumn("before", F.lag("n").over(W.partitionBy("file", "variant").orderBy("pos")))
    return lagged.filter((F.col("n") < F.col("before")) | (F.col("n") > F.col("before") + 1)).select("file", "variant", "label", "n", "before")


def lint(files: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """(file, line, rule, message) of ``files`` (file, text); ``rules``: those to look for, all by default.

    Only what the asked rules need is worked out: windows where one of them needs a window.
    """
    asked = tuple(MESSAGES) if rules is None else tuple(rules)
    if unknown := set(asked) - set(MESSAGES):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    some = lambda group: tuple(r for r in asked if r in group)
    every, found = _lines(files), []
    if some(FILE_RULES):
        found.append(_file_rules(files, some(FILE_RULES)))
    if some(META_RULES):
        found.append(_meta_rules(every).filter(F.col("rule").isin(*some(META_RULES))))
    if "lint_ws_only" in asked:
        found.append(every.filter((F.col("raw") != "") & (F.col("t") == "")).select("file", "line", F.lit("lint_ws_only").alias("rule")))
    if "lint_verse_sequence" in asked:
        found.append(verse_sequence(_checked(files)).select("file", F.lit(0).alias("line"), F.lit("lint_verse_sequence").alias("rule")))
    if "lint_variant_label" in asked:
        found.append(_label_rules(every))
    text = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    if not found:
        return _file_rules(files, ()).withColumn("message", text[F.col("rule")])
    return reduce(DataFrame.unionByName, found).withColumn("message", text[F.col("rule")])


def summary(files: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: files, files with errors, files without, errors."""
    per_file = violations.groupBy("file").agg(F.count("*").alias("n"))
    joined = files.select("file").join(per_file, "file", "left")
    return joined.agg(F.count("*").alias("files"), F.count("n").alias("files_with_errors"), (F.count("*") - F.count("n")).alias("ok_files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("errors"))
