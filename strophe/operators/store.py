"""Collections, links and songs: lookups, joins, counts and mutations as functions of DataFrames.

Frames: ``songs`` (number, title, ...), ``collections`` (id, name, isFavorite, createdAt, ...), ``links``
(id, collectionId, songNumber, variantIndex, ...). Reads take a missing variantIndex for 0; checks for an
existing link compare it as it is, so a missing one never matches. A mutation returns the new frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators.ranking import best_of, with_ordinal


def _variant(index: str = "variantIndex") -> Column:
    return F.coalesce(F.col(index), F.lit(0))


def _favorite() -> Column:
    return F.coalesce(F.col("isFavorite"), F.lit(0)) == 1


class AbsentError(LookupError):
    """A row that a mutation needs is not there."""


class DuplicateError(ValueError):
    """A row that a mutation would add is there already."""


# Lookups and scans


def get_song(songs: DataFrame, number: int) -> DataFrame:
    return songs.filter(F.col("number") == number)


def get_collection(collections: DataFrame, key: int) -> DataFrame:
    return collections.filter(F.col("id") == key)


def scan_keys(songs: DataFrame) -> DataFrame:
    """The numbers alone, ascending: the scan reads one column."""
    return songs.select("number").orderBy("number")


def scan_collections(collections: DataFrame) -> DataFrame:
    return collections.orderBy("id")


def count_songs(songs: DataFrame) -> DataFrame:
    return songs.agg(F.count("*").alias("songs"))


def count_in_collection(links: DataFrame, key: int) -> DataFrame:
    return links.filter(F.col("collectionId") == key).agg(F.count("*").alias("songs"))


def count_per_collection(links: DataFrame) -> DataFrame:
    return links.groupBy("collectionId").agg(F.count("*").alias("songsCount"))


def collections_with_counts(collections: DataFrame, links: DataFrame) -> DataFrame:
    """Counts are made per key before the join, so a hot collection is one row by then."""
    counts = count_per_collection(links).withColumnRenamed("collectionId", "id")
    return collections.join(counts, "id", "left").withColumn("songsCount", F.coalesce("songsCount", F.lit(0)))


def sort_collections(collections: DataFrame) -> DataFrame:
    """Favourites first, the others by their time, then by id."""
    return collections.orderBy(F.when(_favorite(), 0).otherwise(1), "createdAt", "id")


def filter_not_favorite(collections: DataFrame) -> DataFrame:
    return collections.filter(~_favorite())


# Joins


def songs_in_collection(links: DataFrame, songs: DataFrame, key: int) -> DataFrame:
    """One row a link of the collection, by number, then link; links to no song drop out."""
    own = links.filter(F.col("collectionId") == key).select(F.col("id").alias("link_id"), F.col("songNumber").alias("number"), _variant().alias("variantIndex"))
    return own.join(songs, "number").orderBy("number", "link_id")


def collections_for_song(links: DataFrame, collections: DataFrame, number: int) -> DataFrame:
    own = links.filter(F.col("songNumber") == number).select(F.col("id").alias("link_id"), F.col("collectionId").alias("id"), _variant().alias("variantIndex"))
    return own.join(collections, "id").orderBy("link_id")


def available_collections(links: DataFrame, collections: DataFrame, number: int, variant: int = 0) -> DataFrame:
    """Collections without this song and variant, with the number of their links."""
    linked = links.filter((F.col("songNumber") == number) & (_variant() == variant)).select(F.col("collectionId").alias("id")).distinct()
    return collections_with_counts(collections.join(linked, "id", "left_anti"), links)


def favorite_id(collections: DataFrame) -> DataFrame:
    """One row: the smallest id of a favourites collection, null where there is none."""
    return collections.filter(_favorite()).agg(F.min("id").alias("collectionId"))


def is_in_favorite(links: DataFrame, collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (songNumber, variantIndex) of ``wanted`` that the favourites collection holds."""
    own = links.join(F.broadcast(favorite_id(collections)), "collectionId", "left_semi").select("songNumber", "variantIndex").distinct()
    return wanted.join(own, ["songNumber", "variantIndex"], "left_semi")


def hit_titles(hits: DataFrame, songs: DataFrame, unknown: str) -> DataFrame:
    """``hits`` (n, ...) with the title of each, or ``unknown``."""
    titles = songs.select(F.col("number").cast("string").alias("n"), F.col("title").alias("found"))
    return hits.join(titles, "n", "left").withColumn("title", F.coalesce("found", F.lit(unknown))).drop("found")


# Mutations


def load_replace(incoming: DataFrame, ordinal: str) -> DataFrame:
    """The rows that replace the songs: cast, empty content null, the last of each number.

    ``incoming``: (n, title, variants, ``ordinal``); ``variants`` may be null where an older ``body`` stands.
    """
    part = "struct<id:bigint,n:bigint,type:string,content:string,repeatId:string>"

    def one(p: Column) -> Column:
        fields = {f.name for f in incoming.schema["variants"].dataType.elementType["body"].dataType.elementType.fields}
        repeat = F.nullif(p["repeatId"].cast("string"), F.lit("")) if "repeatId" in fields else F.lit(None).cast("string")
        return F.struct(p["id"].cast("long").alias("id"), p["n"].cast("long").alias("n"), p["type"].cast("string").alias("type"), F.nullif(p["content"].cast("string"), F.lit("")).alias("content"), repeat.alias("repeatId"))

    variants = F.transform("variants", lambda v: F.struct(F.coalesce(v["label"].cast("string"), F.lit("")).alias("label"), F.coalesce(F.transform(v["body"], one), F.array().cast(f"array<{part}>")).alias("body")))
    last = best_of(incoming, ["n"], F.desc(ordinal))
    return last.select(F.col("n").cast("long").alias("number"), F.col("title").cast("string").alias("title"), variants.alias("variants"))


def create_collection(collections: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """``collections`` and a new row for each of ``names`` (name): repeated and empty names are allowed."""
    top = collections.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    fresh = with_ordinal(names.select("name"), "id", F.col("name"), first=top + 1)
    return collections.unionByName(fresh.select("id", "name", now.alias("createdAt"), now.alias("updatedAt")), allowMissingColumns=True)


def _same_link(collection: int, number: int, variant: int | None) -> Column:
    return F.coalesce((F.col("collectionId") == collection) & (F.col("songNumber") == number) & (F.col("variantIndex") == variant), F.lit(False))


def add_link(links: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """``links`` and those of ``wanted`` (collectionId, songNumber, variantIndex, ...) that are not there.

    ``strict`` raises if one is there already, as a single insertion does.
    """
    keys = ["collectionId", "songNumber", "variantIndex"]
    fresh = wanted.dropDuplicates(keys).join(links.select(*keys).distinct(), keys, "left_anti")
    if strict and not fresh.limit(1).count():
        raise DuplicateError("the link is there already")
    top = links.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return links.unionByName(with_ordinal(fresh, "id", *map(F.col, keys), first=top + 1), allowMissingColumns=True)


def remove_link(links: DataFrame, collection: int, number: int, variant: int = 0) -> DataFrame:
    same = _same_link(collection, number, variant)
    if not links.filter(same).limit(1).count():
        raise AbsentError("no such link")
    return links.filter(~same)


def delete_collection(collections: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames without the collections of ``gone`` (id) and their links."""
    ids = gone.select("id").distinct()
    return collections.join(ids, "id", "left_anti"), links.join(ids.withColumnRenamed("id", "collectionId"), "collectionId", "left_anti")


def ensure_favorite(collections: DataFrame, name: str, now: Column) -> DataFrame:
    """``collections``, and a favourites row where there is none."""
    there = collections.filter(_favorite()).select(F.lit(1).alias("isFavorite")).limit(1)
    fresh = collections.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(name).alias("name"), F.lit(1).alias("isFavorite"), now.alias("createdAt"), now.alias("updatedAt"))
    return collections.unionByName(fresh.join(F.broadcast(there), "isFavorite", "left_anti"), allowMissingColumns=True)


def _favorite_key(collections: DataFrame) -> int:
    key = favorite_id(collections).first()["collectionId"]
    if key is None:
        raise AbsentError("no favourites collection")
    return key


def favorite_add(links: DataFrame, collections: DataFrame, number: int, variant: int = 0) -> DataFrame:
    spark = links.sparkSession
    wanted = spark.createDataFrame([(_favorite_key(collections), number, variant)], "collectionId long, songNumber long, variantIndex int")
    return add_link(links, wanted, strict=True)


def favorite_remove(links: DataFrame, collections: DataFrame, number: int, variant: int = 0) -> DataFrame:
    return remove_link(links, _favorite_key(collections), number, variant)


def favorite_toggle(links: DataFrame, collections: DataFrame, number: int, variant: int = 0) -> DataFrame:
    there = links.filter(_same_link(_favorite_key(collections), number, variant)).limit(1).count()
    return (favorite_remove if there else favorite_add)(links, collections, number, variant)


def bootstrap_if_empty(songs: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` where there are no songs yet, else the songs."""
    return songs if songs.limit(1).count() else incoming


# Older layouts of the store


def migrate_variants(songs: DataFrame) -> DataFrame:
    """Version 1 to 2: ``body`` becomes the only variant; rows with neither go."""
    single = F.when(F.col("body").isNotNull(), F.array(F.struct(F.lit("").alias("label"), F.col("body").alias("body"))))
    return songs.withColumn("variants", F.coalesce("variants", single)).filter(F.col("variants").isNotNull()).drop("body")


def migrate_variant_label(links: DataFrame) -> DataFrame:
    """Version 2 to 3."""
    return links.withColumn("variantLabel", F.lit(""))


def migrate_variant_index(links: DataFrame) -> DataFrame:
    """Version 3 to 4."""
    return links.drop("variantLabel").withColumn("variantIndex", F.lit(0))


def prev_next(songs: DataFrame) -> DataFrame:
    """(number, prev, next) in number order.

    Numbers get their dense place first, and a self-join of neighbouring places follows: no window runs
    over all rows.
    """
    placed = with_ordinal(songs.select("number").distinct(), "at", F.col("number"))
    both = placed.select("number", F.explode(F.array(*[F.struct((F.col("at") + d).alias("at"), F.lit(d).alias("d")) for d in (-1, 0, 1)])).alias("x")).select("number", "x.at", "x.d")
    out = both.groupBy("at").agg(*[F.max(F.when(F.col("d") == d, F.col("number"))).alias(c) for d, c in ((0, "number"), (1, "prev"), (-1, "next"))])
    return out.filter(F.col("number").isNotNull()).select("number", "prev", "next")
