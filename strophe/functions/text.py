"""Scalar text functions as Column expressions: they stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and marks of the text format.
CLEANED = r"""[/\[\]()!?.,;:"'\-]"""
SPACE = r"(?U)\s+"
CHORUS = "Припев"
VERSE_LINE = r"^([0-9]+)\."
REPEAT_TOKEN = r"//|/\s*[0-9]+\s*р\s*\.?|/|[^/]+"
CLOSE_TOKEN = r"^/\s*([0-9]+)\s*р\s*\.?\z"
REPEAT_PLAIN = r"/[^/]*?/\s*[0-9]+\s*р\.?"
REPEAT_CLOSED = r"/[^/]+?\s*/\s*[0-9]+\s*р\.?"
ALPHABET = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def strip_space(x: Column) -> Column:
    """White space of any kind off both ends (``trim`` knows the blank alone)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def clean_text(x: Column) -> Column:
    """Punctuation becomes a space, runs of white space one blank; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), CLEANED, " "), SPACE, " "))


def lowered(x: Column) -> Column:
    """Lower case that equals that of the cleaned text once it is cleaned: only a capital sigma minds what follows it."""
    return F.when(F.contains(x, F.lit("Σ")), F.lower(clean_text(x))).otherwise(F.lower(F.coalesce(x, F.lit(""))))


def flatten_text(x: Column) -> Column:
    """Cleaned, lower-cased, without white space."""
    return F.regexp_replace(F.lower(clean_text(x)), SPACE, "")


def strip_stage_directions(x: Column) -> Column:
    return F.regexp_replace(x, r"\[[^\]]*\]", "")


def normalize_ws(x: Column) -> Column:
    """Without stage directions, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(strip_stage_directions(x), SPACE, " "))


def normalize_punct(x: Column) -> Column:
    """No blanks before closing punctuation, one after it where a letter follows."""
    near = F.regexp_replace(x, r" +([!?.,;:)\]])", "$1")
    return F.regexp_replace(near, r"([!?.,;:)])([А-ЯЁA-Zа-яёa-z])", "$1 $2")


def lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def _meta_span(all_lines: Column) -> tuple[Column, Column]:
    """1-based places of the first opening and closing meta line, 0 where there is none."""
    return F.array_position(all_lines, "@meta"), F.array_position(all_lines, "@end")


def strip_meta(x: Column) -> Column:
    """First meta block, text form: a block without lines inside stays. Plain searches, no backtracking."""
    start = F.instr(x, "@meta\n")
    end = F.call_function("locate", F.lit("\n@end"), x, start + 6)
    after = F.when(F.substr(x, end + 5, F.lit(1)) == "\n", end + 6).otherwise(end + 5)
    return F.when((start > 0) & (end > 0), F.concat(F.substr(x, F.lit(1), start - 1), F.substr(x, after))).otherwise(x)


def without_meta(all_lines: Column) -> Column:
    """Lines outside the meta block, line form."""
    start, end = _meta_span(all_lines)
    kept = F.filter(all_lines, lambda _, i: (i + 1 < start) | (i + 1 > end))
    return F.when((start > 0) & (end > start), kept).otherwise(all_lines)


def strip_meta_lines(x: Column) -> Column:
    """Meta block off, line form: the lines must be exactly ``@meta`` and ``@end``."""
    return F.array_join(without_meta(lines(x)), "\n")


def extract_body(x: Column) -> Column:
    """Text without header and meta block; blank lines are collapsed only where a block was cut out."""
    all_lines = lines(x)
    start, end = _meta_span(all_lines)
    headed = F.get(all_lines, F.lit(0)).rlike(r"^#[0-9]+")
    second_blank = F.coalesce(F.trim(F.get(all_lines, F.lit(1))) == "", F.lit(False))
    skip = F.when(headed & second_blank, 2).when(headed, 1).otherwise(0)
    has_block = (start > 0) & (end > start)
    rest = F.array_join(F.slice(F.when(has_block, without_meta(all_lines)).otherwise(all_lines), skip + 1, F.size(all_lines) + 1), "\n")
    return F.when(has_block, strip_space(F.regexp_replace(rest, r"\n{3,}", "\n\n"))).otherwise(rest)


def extract_chords(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\{[^}]+\}"), F.lit(0))


def extract_repeats(x: Column) -> Column:
    """Repeats of both notations, sorted; those of the first keep their duplicates."""
    flat = F.regexp_replace(x, SPACE, " ")
    first = F.transform(F.regexp_extract_all(flat, F.lit(REPEAT_PLAIN), F.lit(0)), normalize_ws)
    second = F.transform(F.regexp_extract_all(flat, F.lit(REPEAT_CLOSED), F.lit(0)), normalize_ws)
    return F.array_sort(F.concat(first, F.array_except(second, first)))


def tokenize_repeats(x: Column) -> Column:
    """array<struct<type,value,count>>: text, open and close marks in order; ``//`` opens twice."""

    def token(s: Column) -> Column:
        def one(kind: str, value: Column, count: Column) -> Column:
            return F.struct(F.lit(kind).alias("type"), value.alias("value"), count.alias("count"))

        none = F.lit(None).cast("string")
        opened = one("open", none, none)
        return (
            F.when(s == "//", F.array(opened, opened))
            .when(s == "/", F.array(opened))
            .when(s.rlike(CLOSE_TOKEN), F.array(one("close", none, F.regexp_extract(s, CLOSE_TOKEN, 1))))
            .otherwise(F.array(one("text", s, none)))
        )

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(REPEAT_TOKEN), F.lit(0)), token))


def strip_repeats(x: Column) -> Column:
    """Text without marks; a text without a slash is left as it is."""
    texts = F.filter(tokenize_repeats(x), lambda t: t["type"] == "text")
    plain = F.trim(F.regexp_replace(F.array_join(F.transform(texts, lambda t: t["value"]), ""), SPACE, " "))
    return F.when(F.coalesce(x, F.lit("")) == "", "").when(x.contains("/"), plain).otherwise(x)


def has_chords(x: Column, shown: bool = True) -> Column:
    return F.coalesce(x.contains("{"), F.lit(False)) & F.lit(shown)


def is_number_query(x: Column) -> Column:
    return strip_space(x).rlike(r"^[0-9]+\z")


def parse_ref(ref: Column) -> Column:
    """struct<n, variantIndex> of ``n:index``; the index is 0 where it is missing or no number."""
    cut = F.instr(ref, ":")
    index = F.coalesce(F.regexp_extract(F.substr(ref, cut + 1), r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))
    whole = F.struct(ref.alias("n"), F.lit(0).alias("variantIndex"))
    return F.when(cut > 1, F.struct(F.substr(ref, F.lit(1), cut - 1).alias("n"), index.alias("variantIndex"))).otherwise(whole)


def variant_tab_label(label: Column, index: Column) -> Column:
    """The label, or the letter of the variant's place."""
    return F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(F.substr(F.lit(ALPHABET), index + 1, F.lit(1)))


def variant_label_lookup(variants: Column, index: Column) -> Column:
    """Empty for a single variant, else the label of the variant at ``index``."""
    return F.when(F.size(variants) <= 1, "").otherwise(F.coalesce(F.get(variants, index)["label"], F.lit("")))


def pluralize_ru(n: Column, one: str, few: str, many: str, empty_zero: bool = True) -> Column:
    """Slavic plural forms; ``empty_zero`` gives an empty word for 0."""
    tens, units = F.abs(n) % 100, F.abs(n) % 10
    out = F.when((tens > 10) & (tens < 20), many).when((units > 1) & (units < 5), few).when(units == 1, one).otherwise(many)
    return F.when(n == 0, "").otherwise(out) if empty_zero else out


def title_fallback(name: Column, first_line: Column, most: int = 50) -> Column:
    """The name; else the first line, cut with dots after ``most`` characters."""
    cut = F.when(F.length(first_line) > most, F.concat(F.substring(first_line, 1, most), F.lit("..."))).otherwise(first_line)
    return F.coalesce(F.nullif(name, F.lit("")), cut)
