"""Song texts to nested records and back: gaps and islands over exploded lines, one shuffle by file.

Frames: ``files`` (file, text); ``songs`` (file, id, n, title, variants); parts as rows
(file, variant, pos, type, id, n, content). Lines of one file are bounded by the file, so windows are
partitioned by file and never run over the whole input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import CHORUS, lines, strip_meta, strip_space, title_fallback
from strophe.operators.ranking import with_ordinal

HEADER = r"^#([0-9]+)\s+(.+)\z"
VERSE = r"^([0-9]+)\.\s*((?s).*)\z"
CHORUS_LINE = rf"(?iu)^{CHORUS}(?::|.)\s*((?s).*)\z"
BOUNDARY = re.compile(r"(?:^|\n\s*\n)\(([^)]+)\)\s*(?=[0-9]+\.|Припев[:\s])", re.IGNORECASE)
PART = "struct<id:bigint,n:bigint,type:string,content:string>"
VARIANTS = f"array<struct<label:string,body:array<{PART}>>>"


def parse_header(files: DataFrame) -> DataFrame:
    """(file, n, title, ok): ``n`` and ``title`` are null where the first line is no header."""
    first = F.get(lines(F.col("text")), F.lit(0))
    ok = first.rlike(HEADER)
    number = F.when(ok, F.regexp_extract(first, HEADER, 1).try_cast("long"))
    return files.select("file", number.alias("n"), F.when(ok, strip_space(F.regexp_extract(first, HEADER, 2))).alias("title"), F.coalesce(ok, F.lit(False)).alias("ok"))


def rejected(files: DataFrame) -> DataFrame:
    """(file, message) of the files that have no header and are skipped."""
    first = F.get(lines(F.col("text")), F.lit(0))
    return parse_header(files).filter(~F.col("ok")).join(files, "file").select("file", F.concat(F.lit('bad header: "'), first, F.lit('"')).alias("message"))


def body_text(text: Column) -> Column:
    """What follows the header and its blank line, without the meta block."""
    every = lines(text)
    blank = F.coalesce(strip_space(F.get(every, F.lit(1))) == "", F.lit(False))
    rest = F.array_join(F.slice(every, F.when(blank, 3).otherwise(2), F.size(every)), "\n")
    return strip_space(strip_meta(strip_space(rest)))


def meta_fields(files: DataFrame) -> DataFrame:
    """(file, line, field, value) of the lines inside the meta block; ``line`` from 1."""
    every = files.select("file", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    w = W.partitionBy("file")
    marked = every.withColumns({"start": F.min(F.when(F.col("line") == "@meta", F.col("pos"))).over(w), "end": F.min(F.when(F.col("line") == "@end", F.col("pos"))).over(w)})
    inside = marked.filter((F.col("pos") > F.col("start")) & (F.col("pos") < F.col("end"))).withColumn("line", strip_space(F.col("line")))
    field = r"^([A-Za-z0-9_]+):\s*(.*)\z"
    found = inside.filter(F.col("line").rlike(field))
    return found.select("file", (F.col("pos") + 1).alias("line_no"), F.regexp_extract("line", field, 1).alias("field"), strip_space(F.regexp_extract("line", field, 2)).alias("value"))


def variants_of(content: str) -> list[tuple[str, str]]:
    """(label, content) of each variant; text before the first label is a variant without one."""
    cuts = list(BOUNDARY.finditer(content))
    if not cuts:
        return [("", content)]
    ends = [m.start() for m in cuts[1:]] + [len(content)]
    out = [(m[1], content[m.end() : end].strip()) for m, end in zip(cuts, ends, strict=True)]
    head = content[: cuts[0].start()].strip()
    return [("", head), *out] if head else out


def split_variants(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, variant, label, content from (``keys``, body). A boundary needs lookahead and the text
    between two matches, which is what the one Arrow step here is for."""
    schema = ", ".join(f"{bodies.schema[k].name} {bodies.schema[k].dataType.simpleString()}" for k in keys)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = b["body"].map(lambda x: list(enumerate(variants_of(x or ""))))
            flat = b[keys].assign(v=found).explode("v", ignore_index=True)
            yield flat[keys].assign(variant=[v[0] for v in flat["v"]], label=[v[1][0] for v in flat["v"]], content=[v[1][1] for v in flat["v"]])

    return bodies.select(*keys, "body").mapInPandas(each, f"{schema}, variant int, label string, content string")


def split_parts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, variant, label, part, type, id, n, content: one row a part.

    A part starts at a verse or chorus line, or at the first line of all; other lines belong to the part
    before them. Verses take their number from the text, choruses count up; ids run through the variants.
    """
    own = [*keys, "variant"]
    every = chunks.select(*own, "label", F.posexplode(lines(F.col("content"))).alias("pos", "line")).withColumn("line", strip_space(F.col("line"))).filter(F.col("line") != "")
    by = W.partitionBy(*own).orderBy("pos")
    kind = F.when(F.col("line").rlike(VERSE), "verse").when(F.col("line").rlike(CHORUS_LINE), "chorus")
    started = every.withColumn("kind", kind).withColumn("kind", F.when(F.col("kind").isNull() & (F.row_number().over(by) == 1), "headless").otherwise(F.col("kind")))
    islands = started.withColumn("part", F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(by))
    rest = F.when(F.col("kind") == "verse", F.regexp_extract("line", VERSE, 2)).when(F.col("kind") == "chorus", F.regexp_extract("line", CHORUS_LINE, 1)).otherwise(F.col("line"))
    number = F.when(F.col("kind") == "verse", F.regexp_extract("line", VERSE, 1).try_cast("long")).when(F.col("kind") == "headless", F.lit(1))
    rows = islands.withColumns({"rest": rest, "number": number})
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rest"))), lambda x: x["rest"]), lambda x: x != ""), "\n")
    parts = rows.groupBy(*own, "part").agg(F.first("label").alias("label"), F.max("kind").alias("type"), F.max("number").alias("number"), text.alias("content"))
    parts = parts.withColumn("type", F.when(F.col("type") == "chorus", "chorus").otherwise("verse"))
    chorus = F.row_number().over(W.partitionBy(*own, "type").orderBy("part"))
    running = F.row_number().over(W.partitionBy(*keys).orderBy("variant", "part")) - 1
    return parts.select(
        *own, "label", F.col("part").cast("int").alias("part"), "type", running.cast("long").alias("id"),
        F.when(F.col("type") == "chorus", chorus).otherwise(F.col("number")).cast("long").alias("n"), "content",
    )


def nested(chunks: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, variants: parts gathered into bodies in their order; variants without parts stay, empty."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("part", "id", "n", "type", "content"))), lambda p: F.struct(p["id"], p["n"], p["type"], p["content"]).cast(PART))
    bodies = parts.groupBy(*keys, "variant").agg(body.alias("body"))
    every = chunks.select(*keys, "variant", "label").join(bodies, [*keys, "variant"], "left")
    each = F.struct("variant", "label", F.coalesce("body", F.array().cast(f"array<{PART}>")).alias("body"))
    out = every.groupBy(*keys).agg(F.array_sort(F.collect_list(each), lambda a, b: a["variant"] - b["variant"]).alias("v"))
    return out.select(*keys, F.transform("v", lambda v: F.struct(v["label"].alias("label"), v["body"].alias("body"))).cast(VARIANTS).alias("variants"))


def parse_songs(files: DataFrame) -> DataFrame:
    """(file, id, n, title, variants) of the files with a header; ``id`` is dense in file order."""
    good = parse_header(files).filter("ok").select("file", "n", "title")
    chunks = split_variants(files.select("file", body_text(F.col("text")).alias("body")), ["file"])
    whole = nested(chunks, split_parts(chunks, ["file"]), ["file"])
    return with_ordinal(good.join(whole, "file"), "id", F.col("file")).select("file", "id", "n", "title", "variants")


def assign_song_id(files: DataFrame) -> DataFrame:
    """(file, id): dense place among the files that have a header, in file order."""
    return with_ordinal(parse_header(files).filter("ok").select("file"), "id", F.col("file"))


def song_to_text(songs: DataFrame) -> DataFrame:
    """(n, text): header, blank line, parts parted by blank lines; labels where there is one."""

    def part(p: Column) -> Column:
        verse = F.concat(p["n"].cast("string"), F.lit(". "), p["content"])
        return F.when(p["type"] == "verse", verse).otherwise(F.concat(F.lit(f"{CHORUS}:\n"), p["content"]))

    def variant(v: Column) -> Column:
        body = F.array_join(F.transform(v["body"], part), "\n\n")
        label = F.when(F.coalesce(v["label"], F.lit("")) != "", F.concat(F.lit("("), v["label"], F.lit(")\n"))).otherwise("")
        gap = F.when(F.size(v["body"]) > 0, "\n\n").otherwise("")
        return F.concat(label, body, gap)

    text = F.concat(F.lit("#"), F.col("n").cast("string"), F.lit(" "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("variants", variant), ""))
    return songs.select("n", F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n")).alias("text"))


def move_meta_to_end(files: DataFrame) -> DataFrame:
    """(file, status, new_text): ``moved``, ``already-at-end`` or ``no-meta`` (missing files too)."""
    every = files.select("file", "text", lines(F.col("text")).alias("l")).withColumns({"start": F.array_position("l", "@meta"), "end": F.array_position("l", "@end")})
    blank = lambda x: strip_space(x) == ""
    last = F.coalesce(F.array_max(F.transform("l", lambda x, i: F.when(~blank(x), i))), F.lit(0))
    status = F.when(F.col("text").isNull() | (F.col("start") == 0) | (F.col("end") == 0), "no-meta").when(F.col("end") - 1 >= last - 1, "already-at-end").otherwise("moved")
    block = F.slice("l", F.col("start").cast("int"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0)).cast("int"))
    after = F.slice("l", F.col("end").cast("int") + 1, F.size("l"))
    after = F.when(F.coalesce(blank(F.get(after, F.lit(0))), F.lit(False)), F.slice(after, 2, F.size("l"))).otherwise(after)
    body = F.concat(F.slice("l", F.lit(1), F.col("start").cast("int") - 1), after)
    kept = F.coalesce(F.array_max(F.transform(body, lambda x, i: F.when(~blank(x), i + 1))), F.lit(0))
    moved = F.array_join(F.concat(F.slice(body, F.lit(1), kept), F.array(F.lit("")), block, F.array(F.lit(""))), "\n")
    return every.withColumn("status", status).select("file", "status", F.when(F.col("status") == "moved", moved).otherwise(F.col("text")).alias("new_text"))


def migrate_summary(moved: DataFrame) -> DataFrame:
    return moved.groupBy("status").agg(F.count("*").alias("files"))


# Whole-book form: one text with sections and songs.


def detect_sections(book: DataFrame) -> DataFrame:
    """(book, line_no, title): headings of (book, text). A heading is no song, verse or chorus line, has
    no brackets, starts with a capital, and the next line starts with a number."""
    every = book.select("book", F.posexplode(lines(F.col("text"))).alias("pos", "raw")).withColumn("line", strip_space(F.col("raw")))
    following = F.lead("line").over(W.partitionBy("book").orderBy("pos"))
    marked = every.withColumn("following", following)
    plain = ~F.col("line").rlike(r"^[0-9]+\.\s*[0-9]+\.") & ~F.col("line").rlike(r"^[0-9]+\.\s") & ~F.col("line").rlike(rf"(?iu)^{CHORUS}") & ~F.col("line").rlike(r"[()]")
    heading = marked.filter(plain & F.col("line").rlike(r"^[А-ЯA-Z]") & F.col("following").rlike(r"^[0-9]+\."))
    return heading.select("book", F.col("pos").alias("line_no"), F.col("line").alias("title"))


def split_sections(book: DataFrame) -> DataFrame:
    """(book, id, title, text): what lies between the headings."""
    heads = detect_sections(book).withColumnRenamed("line_no", "pos")
    every = book.select("book", F.posexplode(lines(F.col("text"))).alias("pos", "line")).join(heads, ["book", "pos"], "left")
    by = W.partitionBy("book").orderBy("pos")
    islands = every.withColumn("id", F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(by) - 1).filter("id >= 0")
    body = F.filter(F.array_sort(F.collect_list(F.struct("pos", "line", F.col("title").isNotNull().alias("head")))), lambda x: ~x["head"])
    out = islands.groupBy("book", "id").agg(F.max("title").alias("title"), body.alias("body"))
    return out.select("book", F.col("id").cast("int").alias("id"), "title", strip_space(F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("text"))


SONG_START = r"(?iu)^([0-9]+)\.\s*(?:\([^)\n]*\))?[ \t]+([0-9]+\.|Припев[:.]?)\s*([^\n]+)"


def split_songs_in_section(sections: DataFrame) -> DataFrame:
    """(book, id, n, first_line, text): songs start at a line that carries a song number and verse 1 or a chorus."""
    every = sections.select("book", "id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    second = F.regexp_extract("line", SONG_START, 2)
    start = F.col("line").rlike(SONG_START) & (second.isin("1.", "1") | second.rlike(rf"(?iu)^{CHORUS}"))
    by = W.partitionBy("book", "id").orderBy("pos")
    islands = every.withColumn("start", start).withColumn("song", F.sum(F.col("start").cast("int")).over(by)).filter("song > 0")
    head = F.max(F.when(F.col("start"), F.col("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    out = islands.groupBy("book", "id", "song").agg(head.alias("head"), text.alias("text"))
    return out.select(
        "book", "id", "song", F.regexp_extract("head", SONG_START, 1).cast("long").alias("n"), F.regexp_extract("head", SONG_START, 3).alias("first_line"),
        strip_space(F.regexp_replace(strip_space(F.col("text")), r"^[0-9]+\.\s*", "")).alias("text"),
    )


def parse_book(book: DataFrame, names: DataFrame) -> DataFrame:
    """(book, section, n, title, variants) of a whole book; ``names`` (n, name) has titles for some songs."""
    songs = split_songs_in_section(split_sections(book)).withColumnRenamed("id", "section")
    keys = ["book", "section", "song"]
    chunks = split_variants(songs.withColumnRenamed("text", "body"), keys)
    whole = nested(chunks, split_parts(chunks, keys), keys)
    named = songs.join(names.select("n", "name"), "n", "left").withColumn("title", title_fallback(F.col("name"), F.col("first_line")))
    return named.join(whole, keys).select("book", "section", "n", "title", "variants")


def check_contiguous(songs: DataFrame) -> DataFrame:
    """(n, problem): the first song whose number does not follow its place, and empty variants before it."""
    gap, none = F.col("n") - F.col("id") != 1, F.coalesce(F.size("variants"), F.lit(0)) <= 0
    stop = songs.filter(gap | none).agg(F.min("id")).first()[0]  # one number
    bare = F.exists("variants", lambda v: F.coalesce(F.size(v["body"]), F.lit(0)) <= 0)
    problem = F.when(gap, "number").when(none, "no variants").when(bare, "empty variant")
    rows = songs.select("id", "n", problem.alias("problem")).filter(F.col("problem").isNotNull())
    return rows.filter(F.col("id") <= stop if stop is not None else F.lit(True)).select("n", "problem")
