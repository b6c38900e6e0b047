"""Repeat marks as a tree, and rendering, by windows over the marks of a content.

A stack is not needed. With +1 for an opening mark and -1 for a closing one, the running sum above its own
running minimum is the number of open repeats. A closing mark that makes a new minimum has no partner; an
opening one whose depth is never left again has none either. Of the others the marks of one depth alternate,
so a repeat's count stands in the next mark of its depth. What follows an unclosed mark is outside of it, as
deep as it is below the unclosed ones.

Rows are (key, content) with different keys. The windows run inside one content, however deep it nests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import tokenize_repeats

#: Classes and marks of the rendered form.
MARK = '<span class="repeat-marker">{0}</span>'
ESCAPED = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _marks(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Every token with its ``role`` (text, open, close, or a lone mark that is text), ``depth`` and ``repeats``,
    the count of the repeat that it opens; an empty content has one row without a role."""
    each = rows.select(key, F.posexplode_outer(tokenize_repeats(F.col(content))).alias("pos", "t")).select(key, "pos", "t.*")
    on, back = W.partitionBy(key).orderBy("pos"), W.partitionBy(key).orderBy(F.desc("pos"))
    step = F.when(F.col("type") == "open", 1).when(F.col("type") == "close", -1).otherwise(0)
    summed = each.withColumn("sum", F.sum(step).over(on))
    floored = summed.withColumn("low", F.least(F.lit(0), F.min("sum").over(on)))
    deep = floored.withColumns({"open": F.col("sum") - F.col("low"), "lost": (F.col("type") == "close") & (F.col("low") < F.coalesce(F.lag("low").over(on), F.lit(0)))})
    least = deep.withColumn("least", F.min("open").over(back))
    role = F.when(F.col("lost") | ((F.col("type") == "open") & (F.col("least") == F.col("open"))), "lone").otherwise(F.col("type"))
    told = least.withColumn("role", role)
    left = told.withColumn("unclosed", F.sum(F.when((F.col("role") == "lone") & (F.col("type") == "open"), 1).otherwise(0)).over(on))
    outside = F.col("open") - F.when(F.col("type") == "open", 1).otherwise(0)  # a mark's own level
    depth = F.when(F.col("role") == "lone", 0).otherwise(outside - F.col("unclosed"))
    level = F.when(F.col("role").isin("open", "close"), outside)
    paired = left.withColumns({"depth": depth.cast("int"), "level": level})
    repeats = F.lead("count").over(W.partitionBy(key, "level").orderBy("pos"))
    lone = F.when(F.col("type") == "open", "/").otherwise(F.concat(F.lit("/"), F.col("count"), F.lit("р.")))
    value = F.when(F.col("role") == "text", F.col("value")).when(F.col("role") == "lone", lone)
    return paired.select(key, "pos", "role", "depth", value.alias("value"), "count", F.when(F.col("role") == "open", repeats).alias("repeats"))


def parse_repeats(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, at, depth, type, value, count): the tree in document order, with depths in place of nesting.

    Marks without a partner stay as text: a closing one in its place, an opening one on the top level,
    followed by what it would have enclosed.
    """
    nodes = _marks(rows, key, content).filter("role != 'close'")
    at = F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1
    return nodes.select(key, at.alias("at"), "depth", F.when(F.col("role") == "open", "repeat").otherwise("text").alias("type"), "value", F.col("repeats").alias("count"))


def render_repeats(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, html) of every row."""
    text = F.col("value")
    for raw, safe in ESCAPED:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    before, after = MARK.split("{0}")
    level = F.when(F.col("depth") > 0, F.concat(F.lit(" repeat-depth-"), F.least("depth", F.lit(3)).cast("string"))).otherwise("")
    opened = F.concat(F.lit(MARK.format("/") + '<span class="repeat'), level, F.lit('">'))
    closed = F.concat(F.lit(f"</span>{before}/"), F.col("count"), F.lit(f"р.{after}"))
    piece = F.when(F.col("role") == "open", opened).when(F.col("role") == "close", closed).otherwise(F.coalesce(text, F.lit("")))
    pieces = _marks(rows, key, content).select(key, F.struct("pos", piece.alias("piece")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return pieces.select(key, F.array_join("p.piece", "").alias("html"))


def render_marks(html: Column, show_chords: bool = True) -> Column:
    """Chords, then stage directions, then line ends of a content whose repeats are rendered."""
    out = html
    if show_chords:
        out = F.replace(F.replace(out, F.lit("{_"), F.lit("<span class='chord'>")), F.lit("{"), F.lit("<span class='chord chord-up'>"))
        out = F.replace(out, F.lit("}"), F.lit("</span>"))
    else:
        out = F.regexp_replace(out, r"\{[^}]*\}", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]", "<span class='stage-direction'>$1</span>")
    return F.replace(out, F.lit("\n"), F.lit("<br/>"))


def render_content(rows: DataFrame, key: str, content: str, show_chords: bool = True) -> DataFrame:
    """(key, html) of every row: repeats, then chords, then stage directions, then line ends."""
    return render_repeats(rows, key, content).withColumn("html", render_marks(F.col("html"), show_chords))
