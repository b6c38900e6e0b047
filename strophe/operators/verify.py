"""Two versions of texts compared: findings as (file, severity, check, message) rows.

``versions``: (file, old_text, new_text). Everything about one file is one row of arrays, so comparing
needs no shuffle but for the parts, which come from exploded lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import extract_body, extract_chords, extract_repeats, lines, normalize_punct, normalize_ws, strip_meta_lines, strip_space, strip_stage_directions

VERSE = r"^([0-9]+)(?:\([а-яё]+\))?\.\s"
CHORUS = r"(?iu)^Припев[:.]"
CASE, SPACED, BOTH = "case changed", "space before punctuation removed", "space before punctuation removed and case changed"
#: Which findings each suppression takes away: check column of the finding.
SUPPRESSES = {"repeat": ["repeat_count", "repeat_lost", "repeat_case"], "case": ["case", "repeat_case", "punctuation_case"], "text": ["text"], "punctuation": ["punctuation", "punctuation_case"]}


def parts(texts: DataFrame) -> DataFrame:
    """(file, part, type, n, content) of (file, body): blank lines and bare labels end a part; lines outside
    parts and empty parts drop out; choruses have n = 0."""
    every = texts.select("file", F.posexplode(lines(F.col("body"))).alias("pos", "line")).withColumn("line", strip_space(F.col("line")))
    verse, chorus = F.col("line").rlike(VERSE), F.col("line").rlike(CHORUS)
    close = (F.col("line") == "") | F.col("line").rlike(r"^\([^)]+\)\z")
    by = W.partitionBy("file").orderBy("pos")
    islands = every.withColumns({"start": ~close & (verse | chorus), "close": close}).withColumn("island", F.sum((F.col("start") | F.col("close")).cast("int")).over(by))
    inside = islands.withColumn("opened", F.max(F.col("start").cast("int")).over(W.partitionBy("file", "island"))).filter("opened = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    head = F.max(F.when(F.col("start"), F.col("line")))
    rows = inside.groupBy("file", "island").agg(head.alias("head"), strip_space(text).alias("content")).filter("content != ''")
    kind = F.when(F.col("head").rlike(VERSE), "verse").otherwise("chorus")
    number = F.when(F.col("head").rlike(VERSE), F.regexp_extract("head", VERSE, 1).try_cast("long")).otherwise(F.lit(0))
    return rows.select("file", (F.row_number().over(W.partitionBy("file").orderBy("island")) - 1).alias("part"), kind.alias("type"), number.cast("long").alias("n"), "content")


def part_zip(versions: DataFrame) -> DataFrame:
    """(file, part, type, n, old_content, new_content, old_parts, new_parts): parts by place."""
    old = parts(versions.select("file", extract_body(F.col("old_text")).alias("body")))
    new = parts(versions.select("file", extract_body(F.col("new_text")).alias("body")))
    both = old.withColumnRenamed("content", "old_content").join(new.select("file", "part", F.col("content").alias("new_content"), F.lit(True).alias("there")), ["file", "part"], "full_outer")
    w = W.partitionBy("file")
    return both.withColumns({"old_parts": F.count("type").over(w), "new_parts": F.count("there").over(w)}).drop("there")


def rung(old: Column, new: Column) -> Column:
    """How two normalized texts differ: same, case, punctuation, punctuation_case or text."""
    p, q = normalize_punct(old), normalize_punct(new)
    return F.when(old == new, "same").when(F.lower(old) == F.lower(new), "case").when(p == q, "punctuation").when(F.lower(p) == F.lower(q), "punctuation_case").otherwise("text")


def word_diff(old: Column, new: Column, listed: int = 5) -> Column:
    """Words that differ by place: all of them up to ``listed``, else their number and the first."""
    none = F.lit("∅")
    a, b = F.split(old, " "), F.split(new, " ")
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    shown = lambda x: F.coalesce(F.nullif(x, F.lit("")), none)
    rows = F.transform(places, lambda i: F.when(~F.get(a, i).eqNullSafe(F.get(b, i)), F.concat(F.lit("["), i.cast("string"), F.lit(']: "'), shown(F.get(a, i)), F.lit('" → "'), shown(F.get(b, i)), F.lit('"'))))
    diffs = F.array_compact(rows)
    return F.when(F.size(diffs) <= listed, F.array_join(diffs, ", ")).otherwise(F.concat(F.size(diffs).cast("string"), F.lit(" differences, first: "), F.get(diffs, F.lit(0))))


def _bodies(versions: DataFrame) -> DataFrame:
    cut = versions.select("file", extract_body(F.col("old_text")).alias("a"), extract_body(F.col("new_text")).alias("b"))
    return cut.select("file", normalize_ws(F.col("a")).alias("old"), normalize_ws(F.col("b")).alias("new"))


def text_ladder(versions: DataFrame) -> DataFrame:
    """(file, rung) of the whole bodies."""
    return _bodies(versions).select("file", rung(F.col("old"), F.col("new")).alias("rung"))


def _finding(severity: Column | str, check: Column | str, message: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(severity).alias("severity"), lit(check).alias("check"), message.alias("message"))


def _listed(rows: DataFrame, *findings: Column) -> DataFrame:
    """A row for each finding that is not null.

    Exploded, not filtered: a filter would be pushed below the columns it reads and work out the long
    text expressions behind them once for each mention.
    """
    return rows.select("file", F.explode(F.array_compact(F.array(*findings))).alias("v")).select("file", "v.severity", "v.check", "v.message")


def _text_findings(versions: DataFrame) -> DataFrame:
    told = F.create_map(*[F.lit(x) for pair in {"case": CASE, "punctuation": SPACED, "punctuation_case": BOTH}.items() for x in pair])
    kind = F.col("rung")
    mild = kind.isin("case", "punctuation", "punctuation_case")
    whole = _bodies(versions).select("file", rung(F.col("old"), F.col("new")).alias("rung"))
    first = _listed(whole, F.when(mild, _finding("warning", kind, told[kind])))
    changed = whole.select("file", F.explode(F.when(kind == "text", F.array(F.lit(1)))).alias("_")).drop("_")
    pairs = part_zip(versions.join(changed, "file", "left_semi")).select("file", "part", "type", "n", "old_parts", "new_parts", normalize_ws(F.col("old_content")).alias("old"), normalize_ws(F.col("new_content")).alias("new"))
    even = pairs.filter("old_parts = new_parts").withColumn("rung", rung(F.col("old"), F.col("new")))
    place = F.concat(F.lit(" in "), F.col("type"), F.lit(" "), F.col("n").cast("string"))
    by_part = _listed(
        even, F.when(mild, _finding("warning", kind, F.concat(told[kind], place))), F.when(kind == "text", _finding("error", "text", F.concat(F.lit("text changed"), place))),
        F.when(kind == "text", _finding("error", "words", word_diff(F.col("old"), F.col("new")))),
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("part", F.col(c).alias("x"))))), lambda s: s["x"]), " ")
    total = pairs.filter("old_parts != new_parts").groupBy("file").agg(F.max("old_parts").alias("o"), F.max("new_parts").alias("m"), joined("old").alias("old"), joined("new").alias("new"))
    uneven = total.select("file", "o", "m", rung(F.col("old"), F.col("new")).alias("rung"))
    count = F.concat(F.lit("parts: "), F.col("o").cast("string"), F.lit(" before, "), F.col("m").cast("string"), F.lit(" now"))
    overall = (
        F.when(kind == "case", _finding("warning", "case", F.lit(f"{CASE} in the whole text")))
        .when(mild, _finding("warning", "punctuation", F.lit(f"{SPACED} in the whole text")))
        .when(kind == "text", _finding("error", "whole_text", F.lit("whole text differs: lost or distorted")))
    )
    return first.unionByName(by_part).unionByName(_listed(uneven, _finding("error", "part_count", count), overall))


def marks(versions: DataFrame) -> DataFrame:
    """(file, old_repeats, new_repeats, old_chords, new_chords) outside meta block and stage directions."""
    bare = lambda c: strip_stage_directions(strip_meta_lines(F.col(c)))
    cut = versions.select("file", bare("old_text").alias("a"), bare("new_text").alias("b"))
    return cut.select("file", extract_repeats(F.col("a")).alias("old_repeats"), extract_repeats(F.col("b")).alias("new_repeats"), extract_chords(F.col("a")).alias("old_chords"), extract_chords(F.col("b")).alias("new_chords"))


def lost_repeats(versions: DataFrame) -> DataFrame:
    """(file, repeat, severity): old repeats that are gone (error) or stand in another case (warning)."""
    gone = F.filter("old_repeats", lambda o: ~F.array_contains("new_repeats", o))
    rows = marks(versions).select("file", "new_repeats", F.explode(gone).alias("repeat"))
    cased = F.exists("new_repeats", lambda r: F.lower(r) == F.lower(F.col("repeat")))
    return rows.select("file", "repeat", F.when(cased, "warning").otherwise("error").alias("severity"))


def _row_findings(versions: DataFrame) -> DataFrame:
    """Marks, headers and meta blocks: an array of findings for each file, exploded."""
    m = marks(versions).join(versions.select("file", lines(F.col("old_text")).alias("ol"), lines(F.col("new_text")).alias("nl")), "file")

    def hit(severity: str, check: str, message: Column, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), message.alias("message")))

    def counts(what: str, a: Column, b: Column) -> Column:
        return F.concat(F.lit(f"{what}: "), a.cast("string"), F.lit(" before, "), b.cast("string"), F.lit(" now"))

    number = lambda c: F.nullif(F.regexp_extract(F.get(F.col(c), F.lit(0)), r"^#([0-9]+)", 1), F.lit(""))
    has, closed = F.array_contains("nl", "@meta"), F.array_contains("nl", "@end")
    single = F.array(
        hit("error", "repeat_count", counts("repeats", F.size("old_repeats"), F.size("new_repeats")), F.size("old_repeats") != F.size("new_repeats")),
        hit("error", "chord_count", counts("chords", F.size("old_chords"), F.size("new_chords")), F.size("old_chords") != F.size("new_chords")),
        hit("error", "header", F.concat(F.lit("header number: #"), number("ol"), F.lit(" → #"), number("nl")), number("ol") != number("nl")),
        hit("warning", "meta_absent", F.lit("no meta block"), ~has & ~closed),
        hit("error", "meta_unclosed", F.lit("@meta without @end"), has & ~closed),
        hit("error", "meta_unopened", F.lit("@end without @meta"), ~has & closed),
    )
    k = F.least(F.size("old_chords"), F.size("new_chords"))
    chords = F.zip_with(F.slice("old_chords", F.lit(1), k), F.slice("new_chords", F.lit(1), k), lambda a, b: hit("error", "chord", F.concat(F.lit('chord changed: "'), a, F.lit('" → "'), b, F.lit('"')), a != b))
    found = m.select("file", F.explode(F.array_compact(F.concat(single, chords))).alias("v"))
    return found.select("file", "v.severity", "v.check", "v.message")


#: Checks by what they look at.
TEXT_CHECKS = ("case", "punctuation", "punctuation_case", "text", "words", "part_count", "whole_text")
REPEAT_CHECKS = ("repeat_lost", "repeat_case")
ROW_CHECKS = ("repeat_count", "chord_count", "chord", "header", "meta_absent", "meta_unclosed", "meta_unopened")


def verify(versions: DataFrame, checks: tuple[str, ...] | None = None) -> DataFrame:
    """All findings of the files that have both versions; ``checks``: those to look for, all by default.

    Only what the asked checks need is worked out.
    """
    groups = (TEXT_CHECKS, REPEAT_CHECKS, ROW_CHECKS)
    asked = sum(groups, ()) if checks is None else tuple(checks)
    if unknown := set(asked) - set(sum(groups, ())):
        raise ValueError(f"no such checks: {sorted(unknown)}")
    both = versions.filter(F.col("old_text").isNotNull() & F.col("new_text").isNotNull())
    made = {TEXT_CHECKS: _text_findings, REPEAT_CHECKS: _repeat_findings, ROW_CHECKS: _row_findings}
    found = [made[g](both) for g in groups if set(g) & set(asked)] or [_repeat_findings(both)]
    every = reduce(DataFrame.unionByName, found)
    return every if checks is None else every.filter(F.col("check").isin(*asked))


def _repeat_findings(versions: DataFrame) -> DataFrame:
    repeats = lost_repeats(versions)
    check = F.when(F.col("severity") == "error", "repeat_lost").otherwise("repeat_case")
    told = F.when(F.col("severity") == "error", F.lit('repeat lost: "')).otherwise(F.lit('case changed in repeat: "'))
    return repeats.select("file", "severity", check.alias("check"), F.concat(told, F.col("repeat"), F.lit('"')).alias("message"))


def skipped(versions: DataFrame) -> DataFrame:
    """(file, reason) of the files without one of the versions."""
    reason = F.when(F.col("new_text").isNull(), "file not found").when(F.col("old_text").isNull(), "no old version")
    return versions.select("file", reason.alias("reason")).filter(F.col("reason").isNotNull())


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """``findings`` with ``suppressed``; ``suppressions``: (file_num, check). Chord and header errors stay."""
    spark = findings.sparkSession
    kinds = spark.createDataFrame([(k, c) for k, v in SUPPRESSES.items() for c in v], "by string, check string")
    wanted = suppressions.select(F.concat("file_num", F.lit(".txt")).alias("file"), F.col("check").alias("by")).join(F.broadcast(kinds), "by").select("file", "check").distinct()
    return findings.join(wanted.withColumn("hit", F.lit(True)), ["file", "check"], "left").withColumn("suppressed", F.coalesce("hit", F.lit(False))).drop("hit")


def summary(versions: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of totals; warnings of a file with errors do not count."""
    sums = judged.groupBy("file").agg(
        F.sum(F.when(~F.col("suppressed") & (F.col("severity") == "error"), 1).otherwise(0)).alias("e"),
        F.sum(F.when(~F.col("suppressed") & (F.col("severity") == "warning"), 1).otherwise(0)).alias("w"),
        F.sum(F.col("suppressed").cast("int")).alias("s"),
    )
    whole = F.col("old_text").isNotNull() & F.col("new_text").isNotNull()
    rows = versions.select("file", whole.alias("whole")).join(sums, "file", "left").na.fill(0, ["e", "w", "s"])
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    only = F.col("e") == 0
    return rows.agg(
        total(F.col("whole").cast("int"), "checked"), total((~F.col("whole")).cast("int"), "skipped"), total("s", "suppressed"), total("e", "errors"), total((~only).cast("int"), "files_with_errors"),
        total(F.when(only, F.col("w")).otherwise(0), "warnings"), total((only & (F.col("w") > 0)).cast("int"), "files_with_warnings"),
    )
