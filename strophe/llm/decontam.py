"""Benchmark decontamination by templates.

Texts become token sequences in which numbers, units after a number and names (capitalised words) are
typed placeholders; other words are lower-cased and punctuation goes. Whether a capitalised word at the
start of a sentence is a name cannot be seen: an item enters with both readings. Windows of
``window`` template tokens are hashed and hash-joined with those of the benchmark items, so a question
with other numbers or names still meets its item. The values in the slots must then agree: along one
alignment of item and text, each value of the item stands for one value of the text. A second key of
the same join is the lower-cased window without placeholders, whatever its case and slots: it finds
word-for-word copies.

Templates in which placeholders outnumber words start no alignment, since they meet everything; along one
that another window has started they count unless they are placeholders alone.

A document is contaminated by an item if at least ``least`` different windows of the item are found in
it (thirteen tokens in a row), or ``share`` of all windows of the item if it has few.

Column expressions only. The benchmark's windows (20 bytes each) are broadcast while they are at most
``broadcast_rows``, its items while their tokens take at most 32 bytes for each of these rows; beyond that
the joins shuffle.

Defined cases: whole texts of any length are cut into windows; null texts and texts or items of fewer than ``shortest`` tokens match nothing; items
shorter than a window are compared whole; repeated rows give one row for each item (of
texts under one item id the best match); null item or
document ids are kept as null; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialize

#: Possessive: a group repeated once a number would take a stack frame each.
TOKEN = r"[0-9]++(?:[.,][0-9]++)*+|\p{L}[\p{L}\p{M}'’]*+|[.!?\n]++"
NUMBER, UNIT, NAME = "0num", "0unit", "0name"
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "hour", "hours", "day", "days", "week", "weeks", "year", "years",
    "meters", "metres", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "kilometers", "litres",
)
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "twelve", "twenty", "hundred", "thousand")


def with_tokens(rows: DataFrame, ids: list[str], leading: bool = True) -> DataFrame:
    """``ids``, t, v: template tokens of ``text`` and, for placeholders, the values in the slots.

    ``leading``: capitalised words at the start of a sentence are names too. The raw tokens with their lower
    case are a column of their own, so that a text is cut once and not for each token.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    raw = F.col("raw")
    is_number = lambda x: (x >= "0") & (x < ":")  # noqa: E731  by its first character
    is_stop = lambda x: x < "0"
    nothing = F.lit(None).cast("string")

    def typed(s: Column, i: Column) -> Column:
        x, low, before = s["x"], s["low"], F.get(raw, i - 1)["x"]
        slot = lambda kind: F.struct(F.lit(kind).alias("t"), low.alias("v"))
        name = (low != x) & (F.upper(x) != x)
        return (
            F.when(is_stop(x), F.struct(nothing.alias("t"), nothing.alias("v")))
            .when(is_number(x), slot(NUMBER))
            .when(name if leading else name & before.isNotNull() & ~is_stop(before), slot(NAME))
            .when(low.isin(*NUMBER_WORDS), slot(NUMBER))
            .when(low.isin(*UNITS) & before.isNotNull() & is_number(before), slot(UNIT))
            .otherwise(F.struct(low.alias("t"), nothing.alias("v")))
        )

    both = rows.select(*ids, cut.alias("raw")).select(*ids, F.filter(F.transform(raw, typed), lambda s: s["t"].isNotNull()).alias("tokens"))
    return both.select(*ids, F.col("tokens.t").alias("t"), F.col("tokens.v").alias("v"))


def windows(rows: DataFrame, ids: list[str], sizes: list[int], leading: bool = True) -> DataFrame:
    """``ids``, size, at, key, v: every window of ``text`` by its lower-cased words and by its template.

    A template without a placeholder is the lower-cased window, so it has one key. ``v``: all values of
    the text.
    """
    low = F.zip_with("v", "t", lambda v, t: F.xxhash64(F.coalesce(v, t)))
    hashed = with_tokens(rows, ids, leading).select(*ids, F.transform("t", lambda x: F.xxhash64(x)).alias("h"), low.alias("p"), "v")
    part = lambda name, i, size: F.xxhash64(F.slice(name, i + 1, size))

    def one(size: int) -> Column:
        whole = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(whole, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), part("p", i, size).alias("p"), part("h", i, size).alias("h")))

    each = hashed.select(*ids, "v", F.explode(F.concat(*[one(n) for n in sizes]) if len(sizes) > 1 else one(sizes[0])).alias("w"))
    keys = F.when(F.col("w.p") == F.col("w.h"), F.array("w.p")).otherwise(F.array("w.p", "w.h"))
    return each.select(*ids, "v", "w.size", "w.at", F.posexplode(keys).alias("templated", "key"))


def _aligned(lines: DataFrame) -> DataFrame:
    """``found``: the windows of the item that the text holds along one alignment.

    A window counts if its words are the same, or if its template is, it is not of placeholders alone and
    each value of the item stands for one value of the text along the line.
    """
    there = lambda name, i: F.get(F.col(name), F.col("line") + i)  # noqa: E731  null outside of the text

    def token(t: Column, i: Column) -> Column:
        own, other = F.get("item_v", i), there("v", i)
        same = F.coalesce(there("t", i) == t, F.lit(False))
        exact = F.coalesce(F.coalesce(other, there("t", i)) == F.coalesce(own, t), F.lit(False))
        slot = F.when(own.isNotNull() & same, F.struct(own.alias("own"), other.alias("other")))
        return F.struct(F.when(same, F.when(own.isNull(), "w").otherwise("s")).when(exact, "w").otherwise("-").alias("template"), F.when(exact, "w").otherwise("-").alias("plain"), slot.alias("slot"))

    at = lines.withColumn("x", F.transform("item_t", token))
    at = at.withColumn("template", F.array_join("x.template", "")).withColumn("plain", F.array_join("x.plain", "")).withColumn("slots", F.col("x.slot"))
    places = F.sequence(F.lit(0), F.col("n") - F.col("own"))
    part = lambda name, i: F.substr(F.col(name), i + 1, F.col("own"))
    at = at.withColumn("same", F.filter(places, lambda i: ~part("plain", i).contains("-")))
    at = at.withColumn("like", F.filter(places, lambda i: ~part("template", i).contains("-") & part("template", i).contains("w")))
    pairs = F.array_distinct(F.array_compact(F.flatten(F.transform("like", lambda i: F.slice("slots", i + 1, F.col("own"))))))
    at = at.withColumn("pairs", pairs)
    agrees = F.size("pairs") == F.size(F.array_distinct("pairs.own"))
    return at.withColumn("found", F.when(agrees, F.array_union("same", "like")).otherwise(F.col("same")))


def _matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 6, share: float = 0.6, shortest: int = 4, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, tkey, item_id, n_windows, item_windows); ``tkey`` stands for the text."""
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("ikey", F.xxhash64(F.col("item_id").isNull(), "item_id", "text"))
    counted = with_tokens(items, ["item_id", "ikey", "text"]).withColumn("n", F.size("t")).filter(F.col("n") >= shortest)
    counted = materialize(counted.withColumn("own", F.least("n", F.lit(window))), "items")
    sizes = sorted(r[0] for r in counted.select("own").distinct().collect())  # at most ``window`` values
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id long, tkey long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_windows long, item_windows long")
    both = [windows(counted.select("ikey", "own", "text"), ["ikey", "own"], sizes, leading) for leading in (True, False)]
    slots = F.size(F.array_compact(F.slice("v", F.col("at") + 1, F.col("size"))))
    ours = both[0].union(both[1]).filter("size = own").filter((F.col("templated") == 0) | (slots <= F.col("size") / 2))
    ours = materialize(ours.select("ikey", "key", F.col("at").alias("item_at")).distinct(), "item-windows")

    def small(df: DataFrame, chars: str = "0") -> DataFrame:
        rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.expr(chars)), F.lit(0))).first()
        return F.broadcast(df) if rows <= broadcast_rows and size <= 32 * broadcast_rows else df

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))
    theirs = windows(rows, ["doc_id", "tkey"], sizes).select("doc_id", "tkey", "key", "at")
    hits = materialize(theirs.join(small(ours), "key").select("doc_id", "tkey", "ikey", (F.col("at") - F.col("item_at")).alias("line")), "window-hits")
    lines = materialize(hits.select("tkey", "ikey", "line").distinct(), "lines")
    # texts with a hit are cut again and held against the item along each line
    texts = rows.join(small(lines.select("tkey").distinct()), "tkey", "left_semi").select("tkey", "text").dropDuplicates(["tkey"])
    cut = materialize(with_tokens(texts, ["tkey"]), "hit-texts")
    own = counted.select("ikey", "item_id", "n", "own", F.col("t").alias("item_t"), F.col("v").alias("item_v"))
    held = _aligned(lines.join(small(own, "octet_length(array_join(item_t, '')) + octet_length(array_join(item_v, ''))"), "ikey").join(cut, "tkey")).select("tkey", "ikey", "item_id", "n", "own", "found")
    held = held.groupBy("tkey", "ikey").agg(F.first("item_id").alias("item_id"), F.first(F.col("n") - F.col("own") + 1).cast("long").alias("item_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("n_windows"))
    held = held.filter(F.col("n_windows") >= F.least(F.lit(least), F.ceil(F.col("item_windows") * share)))
    return hits.select("doc_id", "tkey", "ikey").distinct().join(held, ["tkey", "ikey"]).select("doc_id", "tkey", "item_id", "n_windows", "item_windows")


def leaks(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows): a row for each document and item that it holds."""
    out = _matches(docs, benchmark, **kw)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    bad = materialize(_matches(docs, benchmark, **kw).select(F.col("tkey").alias("_bad_text")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(docs["text"].cast("string")) == bad["_bad_text"], "left_anti")
