"""Collections, links, songs and change detection bound to ``orders``, ``lineitem``, ``part`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import changes, ranking, store
from strophe.plans import bindings as b
from strophe.plans.bindings import sql
from strophe.streaming import checks

ORDER, PART = 7, 11
NOW = "TIMESTAMP '2024-01-01 00:00:00'"


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.collections(spark, sf_dir)


def scan_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.part_songs(spark, sf_dir)


def sort_collection_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.songs_in_collection(b.links(spark, sf_dir), b.part_songs(spark, sf_dir), ORDER).select("number", "link_id")


def is_in_favorite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (song, variant) that any link names, against the favourites collection."""
    links = b.links(spark, sf_dir)
    return store.is_in_favorite(links, _c(spark, sf_dir), links.select("songNumber", "variantIndex").distinct())


def hit_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = b.links(spark, sf_dir).select(F.col("songNumber").cast("string").alias("n")).distinct()
    return store.hit_titles(hits, b.part_songs(spark, sf_dir), "unknown")


def create_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each customer name, repeated and empty ones too."""
    names = b.table(spark, sf_dir, "customer").select(F.expr("CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END").alias("name"))
    made = store.create_collection(_c(spark, sf_dir), names, F.expr(NOW))
    return made.groupBy("name").agg(F.count("*").alias("collections"), F.max("id").alias("last_id"))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for each line item one variant further: some are there, some repeat."""
    return b.links(spark, sf_dir).select("collectionId", "songNumber", (F.coalesce("variantIndex", F.lit(0)) + F.when(F.col("songNumber") % 2 == 0, 0).otherwise(1)).cast("int").alias("variantIndex"))


def add_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = store.add_link(b.links(spark, sf_dir), _wanted(spark, sf_dir))
    return added.select("collectionId", "songNumber", "variantIndex")


def remove_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the first link of the first order that has one with a variant."""
    links = b.links(spark, sf_dir)
    one = links.filter("variantIndex IS NOT NULL").orderBy("id").first()
    return store.remove_link(links, one["collectionId"], one["songNumber"], one["variantIndex"])


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status P."""
    return b.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))


def delete_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_collection(_c(spark, sf_dir), b.links(spark, sf_dir), _gone(spark, sf_dir))[0].select("id")


def delete_collection_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_collection(_c(spark, sf_dir), b.links(spark, sf_dir), _gone(spark, sf_dir))[1].select("id", "collectionId")


def _favorite_links(change):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        links = change(b.links(spark, sf_dir), _c(spark, sf_dir))
        return links.groupBy("collectionId").agg(F.count("*").alias("links"))

    return query


def ensure_favorite(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = _c(spark, sf_dir).withColumn("isFavorite", F.lit(None).cast("int"))
    there = store.ensure_favorite(_c(spark, sf_dir), "favorites", F.expr(NOW)).agg(F.count("*").alias("n"), F.sum("isFavorite").alias("favorites")).withColumn("case", F.lit("there"))
    made = store.ensure_favorite(none, "favorites", F.expr(NOW)).agg(F.count("*").alias("n"), F.sum("isFavorite").alias("favorites")).withColumn("case", F.lit("made"))
    return there.unionByName(made).select("case", "n", F.col("favorites").cast("long").alias("favorites"))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = b.part_songs(spark, sf_dir)
    kept = store.bootstrap_if_empty(songs, songs.limit(0)).agg(F.count("*").alias("n")).withColumn("case", F.lit("kept"))
    loaded = store.bootstrap_if_empty(songs.limit(0), songs).agg(F.count("*").alias("n")).withColumn("case", F.lit("loaded"))
    return kept.unionByName(loaded)


def migrate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents in the older layout, odd ones in the newer, every seventh in neither."""
    part = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("content")))
    body = F.when(F.expr("doc_id % 7 > 0 AND doc_id % 2 = 0"), part)
    variants = F.when(F.expr("doc_id % 7 > 0 AND doc_id % 2 = 1"), F.array(F.struct(F.lit("x").alias("label"), part.alias("body"))))
    rows = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), body.alias("body"), variants.alias("variants"))
    return store.migrate_variants(rows).select("number", F.col("variants")[0]["label"].alias("label"), F.size(F.col("variants")[0]["body"]).alias("parts"))


def migrate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.migrate_variant_index(store.migrate_variant_label(b.links(spark, sf_dir).drop("variantIndex"))).select("id", "variantIndex")


def should_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as the last check, an hour after the start of its day."""
    last = F.expr("CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 51 = 0 THEN 0 ELSE unix_millis(CAST(ts AS TIMESTAMP)) END")
    now = F.expr("unix_millis(date_trunc('DAY', CAST(ts AS TIMESTAMP))) + 3600000")
    return b.table(spark, sf_dir, "events").select("event_id", changes.should_check(last, now).alias("due"))


def etag_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END").alias("stored"), F.expr("CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'click' ELSE 'view' END").alias("new"),
        F.expr("CAST(CASE WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS INT)").alias("status"), F.expr("event_id % 13 = 0").alias("failed"),
    )
    return changes.etag_changed(rows).select("event_id", "changed", "new_etag")


def perform_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select(
        "event_id", F.expr("event_id % 6 > 0").alias("online"), F.expr("event_id % 4 * 1000000").alias("last_ms"), F.lit(3_000_000).cast("long").alias("now_ms"), F.expr("event_id % 5").alias("songs"),
    )
    return changes.perform_check(rows).select("event_id", "due", "last_ms")


def apply_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead nowhere once the songs are replaced by ones of which the smaller have other numbers."""
    number = F.expr("CASE WHEN p_size > 10 THEN p_partkey ELSE p_partkey + 2000000000 END")
    incoming = b.table(spark, sf_dir, "part").select(number.alias("number"), F.col("p_name").alias("title"))
    return changes.apply_update(b.part_songs(spark, sf_dir), incoming, b.links(spark, sf_dir))[2].select("id", "songNumber")


def limit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven dearest parts: the limit is the feature."""
    return ranking.top(b.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 7, F.desc("p_retailprice"), F.col("p_partkey"))


def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.with_ordinal(rows, "place", F.desc("o_totalprice"), F.col("o_orderkey"), first=1).select("o_orderkey", "place")


#: An event as what a source answered: the time, whether it was reached, what it held, its tag and status.
ANSWER = {
    "source": "CAST(user_id AS STRING)", "at_ms": "{ms}", "online": "event_id % 9 <> 4", "songs": "CAST(event_id % 6 AS INT)", "tag": "concat('v', CAST(CAST(floor(event_id / 400) AS INT) AS STRING))",
    "status": "CASE WHEN event_id % 13 = 0 THEN 500 ELSE 200 END", "failed": "event_id % 17 = 0",
}


def watch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as answers of a source that is asked at most once in half an hour."""
    events = b.table(spark, sf_dir, "events")
    return checks.watched(events.select(*[F.expr(x.format(ms="unix_millis(CAST(ts AS TIMESTAMP))")).alias(k) for k, x in ANSWER.items()]))


QUERIES = {
    "scan_songs": scan_songs,
    "scan_keys": lambda s, d: store.scan_keys(b.part_songs(s, d)),
    "scan_collections": lambda s, d: store.scan_collections(_c(s, d)),
    "songs_in_collection": lambda s, d: store.songs_in_collection(b.links(s, d), b.part_songs(s, d), ORDER),
    "collections_for_song": lambda s, d: store.collections_for_song(b.links(s, d), _c(s, d), PART),
    "available_collections": lambda s, d: store.available_collections(b.links(s, d), _c(s, d), PART, 1).select("id", "name", "songsCount"),
    "available_except": lambda s, d: store.available_collections(b.links(s, d), _c(s, d), PART, 0).select("id"),
    "is_in_favorite": is_in_favorite,
    "hit_title_lookup": hit_title_lookup,
    "collections_with_counts": lambda s, d: store.collections_with_counts(_c(s, d), b.links(s, d)).select("id", "songsCount"),
    "count_songs": lambda s, d: store.count_songs(b.part_songs(s, d)),
    "count_in_collection": lambda s, d: store.count_in_collection(b.links(s, d), ORDER),
    "count_per_collection": lambda s, d: store.count_per_collection(b.links(s, d)),
    "sort_collections": lambda s, d: store.sort_collections(_c(s, d)).select("id", "isFavorite", "createdAt"),
    "sort_collection_songs": sort_collection_songs,
    "filter_not_favorite": lambda s, d: store.filter_not_favorite(_c(s, d)).select("id", "name"),
    "prev_next_song": lambda s, d: store.prev_next(b.part_songs(s, d)),
    "get_song": lambda s, d: store.get_song(b.part_songs(s, d), PART),
    "get_collection": lambda s, d: store.get_collection(_c(s, d), ORDER),
    "create_collection": create_collection,
    "add_link": add_link,
    "remove_link": remove_link,
    "delete_collection": delete_collection,
    "delete_collection_links": delete_collection_links,
    "favorite_add": _favorite_links(lambda links, c: store.favorite_add(links, c, 999_999_999)),
    "favorite_remove": _favorite_links(lambda links, c: store.favorite_remove(store.favorite_add(links, c, 999_999_999), c, 999_999_999)),
    "favorite_toggle": _favorite_links(lambda links, c: store.favorite_toggle(links, c, 999_999_999)),
    "ensure_favorite": ensure_favorite,
    "bootstrap_if_empty": bootstrap,
    "migrate_variants": migrate_variants,
    "migrate_links": migrate_links,
    "should_check": should_check,
    "etag_changed": etag_changed,
    "perform_check": perform_check,
    "watch_checks": watch_checks,
    "apply_update": apply_update,
    "limit_topk": limit_topk,
    "ordinal": ordinal,
}
LC, LS, ALL = ("links", "collections"), ("links", "songs"), ("links", "collections", "songs")
COUNTS = "SELECT collectionId, count(*) AS songsCount FROM links GROUP BY 1"
FAV = "SELECT min(id) AS fid FROM collections WHERE isFavorite = 1"
WANTED = "SELECT DISTINCT collectionId, songNumber, CAST(coalesce(variantIndex, 0) + CASE WHEN songNumber % 2 = 0 THEN 0 ELSE 1 END AS INT) AS variantIndex FROM links"
ADDED = "SELECT collectionId, count(*) AS links FROM (SELECT collectionId FROM links UNION ALL SELECT fid FROM fav) GROUP BY 1"
_AVAILABLE = "SELECT id, name, coalesce(songsCount, 0) AS songsCount FROM collections LEFT JOIN counts ON collectionId = id WHERE id NOT IN (SELECT collectionId FROM links WHERE songNumber = {0} AND coalesce(variantIndex, 0) = {1})"
ORACLE_SQL = {
    "scan_songs": sql(("songs",), "SELECT * FROM songs"),
    "scan_keys": sql(("songs",), "SELECT number FROM songs ORDER BY number"),
    "scan_collections": sql(("collections",), "SELECT * FROM collections ORDER BY id"),
    "songs_in_collection": sql(LS, f"SELECT number, l.id AS link_id, coalesce(variantIndex, 0) AS variantIndex, title FROM links l JOIN songs ON songNumber = number WHERE collectionId = {ORDER}"),
    "collections_for_song": sql(LC, f"SELECT c.id, l.id AS link_id, coalesce(variantIndex, 0) AS variantIndex, name, isFavorite, createdAt, updatedAt FROM links l JOIN collections c ON collectionId = c.id WHERE songNumber = {PART}"),
    "available_collections": sql(LC, _AVAILABLE.format(PART, 1), counts=COUNTS),
    "available_except": sql(LC, f"SELECT id FROM ({_AVAILABLE.format(PART, 0)})", counts=COUNTS),
    "is_in_favorite": sql(LC, "SELECT DISTINCT songNumber, variantIndex FROM links a WHERE EXISTS (SELECT 1 FROM links x, fav WHERE x.collectionId = fid AND x.songNumber = a.songNumber AND x.variantIndex = a.variantIndex)", fav=FAV),
    "hit_title_lookup": sql(LS, "SELECT DISTINCT songNumber::VARCHAR AS n, coalesce(title, 'unknown') AS title FROM links LEFT JOIN songs ON number = songNumber"),
    "collections_with_counts": sql(LC, "SELECT id, coalesce(songsCount, 0) AS songsCount FROM collections LEFT JOIN counts ON collectionId = id", counts=COUNTS),
    "count_songs": sql(("songs",), "SELECT count(*) AS songs FROM songs"),
    "count_in_collection": sql(("links",), f"SELECT count(*) AS songs FROM links WHERE collectionId = {ORDER}"),
    "count_per_collection": sql(("links",), COUNTS),
    "sort_collections": sql(("collections",), "SELECT id, isFavorite, createdAt FROM collections ORDER BY coalesce(isFavorite, 0) DESC, createdAt, id"),
    "sort_collection_songs": sql(LS, f"SELECT number, l.id AS link_id FROM links l JOIN songs ON songNumber = number WHERE collectionId = {ORDER}"),
    "filter_not_favorite": sql(("collections",), "SELECT id, name FROM collections WHERE coalesce(isFavorite, 0) = 0"),
    "prev_next_song": sql(("songs",), "SELECT number, lag(number) OVER (ORDER BY number) AS prev, lead(number) OVER (ORDER BY number) AS next FROM songs"),
    "get_song": sql(("songs",), f"SELECT * FROM songs WHERE number = {PART}"),
    "get_collection": sql(("collections",), f"SELECT * FROM collections WHERE id = {ORDER}"),
    "create_collection": sql(
        ("collections",), "SELECT name, count(*) AS collections, max(id) AS last_id FROM (SELECT id, name FROM collections UNION ALL SELECT (SELECT max(id) FROM collections) + row_number() OVER (ORDER BY name), name FROM fresh) GROUP BY name",
        fresh="SELECT CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS name FROM customer",
    ),
    "add_link": sql(("links",), "SELECT collectionId, songNumber, variantIndex FROM links UNION ALL SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.collectionId = w.collectionId AND l.songNumber = w.songNumber AND l.variantIndex = w.variantIndex)", wanted=WANTED),
    "remove_link": sql(
        ("links",), "SELECT * FROM links WHERE NOT coalesce(collectionId = (SELECT collectionId FROM one) AND songNumber = (SELECT songNumber FROM one) AND variantIndex = (SELECT variantIndex FROM one), false)",
        one="SELECT * FROM links WHERE variantIndex IS NOT NULL ORDER BY id LIMIT 1",
    ),
    "delete_collection": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'",
    "delete_collection_links": sql(("links",), "SELECT id, collectionId FROM links WHERE collectionId NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"),
    "favorite_add": sql(LC, ADDED, fav=FAV),
    "favorite_remove": sql(("links",), "SELECT collectionId, count(*) AS links FROM links GROUP BY 1"),
    "favorite_toggle": sql(LC, ADDED, fav=FAV),
    "ensure_favorite": sql(("collections",), "SELECT 'there' AS \"case\", count(*) AS n, CAST(sum(isFavorite) AS BIGINT) AS favorites FROM collections UNION ALL SELECT 'made', count(*) + 1, 1 FROM collections"),
    "bootstrap_if_empty": sql(("songs",), "SELECT count(*) AS n, 'kept' AS \"case\" FROM songs UNION ALL SELECT count(*), 'loaded' FROM songs"),
    "migrate_variants": "SELECT doc_id AS number, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END AS label, CAST(len(string_split(text, chr(10))) AS INT) AS parts FROM documents WHERE doc_id % 7 > 0",
    "migrate_links": sql(("links",), "SELECT id, 0 AS variantIndex FROM links"),
    "should_check": "SELECT event_id, event_id % 50 = 0 OR event_id % 51 = 0 OR epoch_ms(date_trunc('day', ts)) + 3600000 - epoch_ms(ts) >= 1800000 AS due FROM events",
    "etag_changed": """SELECT event_id, NOT bad AND stored <> '' AND new <> '' AND new <> stored AS changed, CASE WHEN bad THEN stored ELSE new END AS new_etag FROM
      (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS stored, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'click' ELSE 'view' END AS new, event_id % 11 = 0 OR event_id % 13 = 0 AS bad FROM events)""",
    "perform_check": """SELECT event_id, due, CASE WHEN due THEN 3000000 ELSE last_ms END AS last_ms FROM
      (SELECT event_id, event_id % 4 * 1000000 AS last_ms, event_id % 6 > 0 AND event_id % 5 > 0 AND (event_id % 4 = 0 OR 3000000 - event_id % 4 * 1000000 >= 1800000) AS due FROM events)""",
    "apply_update": sql(("links",), "SELECT id, songNumber FROM links WHERE songNumber NOT IN (SELECT CASE WHEN p_size > 10 THEN p_partkey ELSE p_partkey + 2000000000 END FROM part)"),
    "limit_topk": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7",
    "ordinal": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
}
#: The same by recursion: a source's rows one after another, with its last check and its tag.
ORACLE_SQL["watch_checks"] = f"""WITH RECURSIVE a AS (SELECT {', '.join(f"{x.format(ms='epoch_us(ts) // 1000')} AS {k}" for k, x in ANSWER.items())} FROM events),
r AS (SELECT source, at_ms, online AND songs > 0 AS able, tag, status = 200 AND NOT failed AS ok, row_number() OVER (PARTITION BY source ORDER BY at_ms, tag, status) AS k FROM a),
f AS (SELECT source, k, at_ms, able AS due, false AS changed, CASE WHEN able AND ok THEN tag ELSE '' END AS tag, CASE WHEN able THEN at_ms END AS last FROM r WHERE k = 1
  UNION ALL SELECT source, k, at_ms, due, due AND ok AND f_tag <> '' AND tag <> f_tag, CASE WHEN due AND ok THEN tag ELSE f_tag END, CASE WHEN due THEN at_ms ELSE last END
  FROM (SELECT r.*, f.tag AS f_tag, f.last, r.able AND (f.last IS NULL OR r.at_ms - f.last >= 1800000) AS due FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1))
SELECT source, at_ms, due, changed, tag FROM f"""
