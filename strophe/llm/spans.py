"""Regular-expression spans as Column expressions: no Python on the executors.

A text is cut by the expression; the lengths of the cuts and of the matches between them give each
match its place in code points. Expressions are Java's; possessive quantifiers and lookbehinds stand
where they leave the leftmost matches as they are and keep long runs linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,match:string,before:string,after:string>>"


#: Matches that one fold walks, and spans that are looked at together.
CHUNK = 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _slices(rows: Column) -> Column:
    """``rows`` cut into arrays of ``CHUNK``."""
    some = F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / CHUNK).cast("int"))
    return F.transform(some, lambda k: F.slice(rows, k * CHUNK + 1, CHUNK))


def find(text: Column, pattern: str, kind: str, context: int = 0) -> Column:
    """The leftmost non-overlapping matches of ``pattern``: start, end (exclusive), kind, match and context.

    Linear in the matches: the text is cut once, and places are summed over chunks of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        n = F.size(found)
        rows = let(F.split(text, pattern, -1), lambda gaps: F.zip_with(F.zip_with(found, F.slice(gaps, 1, n), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), F.slice(gaps, 2, n), lambda x, h: F.struct(x["m"], x["g"], h.alias("h"))))
        return let(let(rows, _slices), summed)

    def summed(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x["m"]) + F.length(x["g"])))
        before = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(F.zip_with(chunks, F.slice(before, 1, F.size(chunks)), folded))

    def folded(chunk: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(None).cast(SPAN).alias("out"))
        return F.aggregate(chunk, start, step, lambda acc: acc["out"])

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["g"])
        end = begin + F.length(row["m"])
        before = F.right(row["g"], F.lit(context)) if context else F.lit("")
        after = F.left(row["h"], F.lit(context)) if context else F.lit("")
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), row["m"].alias("match"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), F.array(one)).alias("out"))

    # texts without a match, nearly all, are not cut
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(SPAN)))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of every span, by start, then in the order of ``kinds``, comma-joined."""
    rank = F.create_map(*[x for k, name in enumerate(kinds) for x in (F.lit(name), F.lit(k))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("k"), s["end"].alias("z"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["z"].cast("string"))), ",")


def overlaps(spans: Column, one: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < one["end"]) & (one["start"] < s["end"]))


def covers(spans: Column) -> Column:
    """``spans`` in chunks by place, each with the range that it covers, for ``meets``."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(let(by_place, _slices), lambda c: F.struct(F.array_min(F.transform(c, lambda s: s["start"])).alias("low"), F.array_max(F.transform(c, lambda s: s["end"])).alias("high"), c.alias("spans")))


def meets(chunks: Column, one: Column, fits=lambda s: F.lit(True)) -> Column:
    """Whether ``one`` overlaps a span of ``chunks`` that fits; chunks that cover other places are passed by."""
    return F.exists(chunks, lambda c: (c["low"] < one["end"]) & (one["start"] < c["high"]) & F.exists(c["spans"], lambda s: (s["start"] < one["end"]) & (one["start"] < s["end"]) & fits(s)))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
