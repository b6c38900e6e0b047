"""Search bound to ``documents`` as songs of two variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import ask, edits, ranking, search, segments, store
from strophe.plans import bindings as b
from strophe.plans.bindings import DOCS, sql
from strophe.sources.readers import fingerprint
from strophe.sources.workspace import fresh_folder

EXACT = "Of the"
LEXICAL = "The, and thean"
FALLBACK = "zzzqq thean"
ONE = "thean"
UI_LIMIT = 7


_sessions: dict[tuple, tuple[tuple, search.SearchSession | segments.LiveIndex]] = {}


def session(spark: SparkSession, sf_dir: str, stem=None) -> search.SearchSession:
    """The written indexes of a folder's documents: built by the first query that needs them, asked by all.

    They are built again once the files are others than those they were built from.
    """
    key = (spark.sparkContext.applicationId, sf_dir, stem)
    files = fingerprint(b.table(spark, sf_dir, "documents"))
    if key not in _sessions or _sessions[key][0] != files:
        _sessions[key] = files, search.SearchSession(b.document_songs(spark, sf_dir), fresh_folder(spark, "search"), stem)
    return _sessions[key][1]


def _exact(spark: SparkSession, sf_dir: str, limit: int = 0) -> DataFrame:
    return _shown(session(spark, sf_dir).search_exact(EXACT, limit))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _lexical(query: str, limit: int = 0, stem=None, **kw):
    return lambda spark, sf_dir: _shown(session(spark, sf_dir, stem).search_lexical(query, limit, **kw))


def _unified(query: str, limit: int = 0):
    return lambda spark, sf_dir: _shown(session(spark, sf_dir).search(query, limit))


def lexical_not_in_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(ONE)(spark, sf_dir).filter("tier = 1").select("n", "variantIndex", "score")


def result_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each hit: exact ones first, by score, then by number."""
    hits = _unified(ONE)(spark, sf_dir).select("n", "tier", "score")
    return ranking.with_ordinal(hits, "place", F.col("tier"), F.desc("score"), F.col("n"), first=1).select("n", "place")


def dedupe_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = session(spark, sf_dir).exact
    scored = index.select("n", F.col("variantIndex").cast("int").alias("variantIndex"), search.exact_score(F.lit("the")).alias("score"))
    return _shown(ranking.best_of(scored.select("*", F.explode(F.when(F.col("score").isNotNull(), F.array(F.lit(1))))).drop("col"), ["n"], F.desc("score"), F.col("variantIndex")))


def search_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_number(b.document_songs(spark, sf_dir), " 42 ").select("number", "title")


def search_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches of one session, asked at once."""
    asked = spark.createDataFrame([(q, q) for q in (ONE, FALLBACK)], "query_id string, query string")
    return _shown(session(spark, sf_dir).search_all(asked)).withColumnRenamed("query_id", "query")


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the names of parts, each once."""
    return b.table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()


def item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the benchmark's whole texts."""
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def search_all(spark: SparkSession, sf_dir: str, limit: int = 0) -> DataFrame:
    """Every part name searched at once."""
    return _shown(session(spark, sf_dir).search_all(part_queries(spark, sf_dir), limit))


def search_all_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark text, blanks and marks aside: all of them asked at once."""
    return _shown(session(spark, sf_dir).search_all_exact(item_queries(spark, sf_dir)))


def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, term, df): the terms of the documents at most two edits from the last word of a part's name."""
    own = session(spark, sf_dir)
    words = ask.query_terms(ask.prepared(part_queries(spark, sf_dir))).filter("last").select(F.col("term").alias("word")).distinct()
    return edits.near_terms(own.neighbourhoods, edits.keys_of(words, own.edits), own.edits).join(own.vocabulary, "term")


#: Documents as they were before the update: some were not there, some had other letters or an end more.
BEFORE = "CASE WHEN doc_id % 7 = 2 THEN lower(text) WHEN doc_id % 11 = 4 THEN concat(coalesce(text, ''), chr(10), 'old ending thean') ELSE text END"


def live_index(spark: SparkSession, sf_dir: str, searched: bool = True) -> segments.LiveIndex:
    """An index of the documents as they were, brought up to date: the difference is one more segment."""
    docs = b.table(spark, sf_dir, "documents")
    key, files = (spark.sparkContext.applicationId, sf_dir, f"live-{searched}"), fingerprint(docs)
    if key not in _sessions or _sessions[key][0] != files:
        old = docs.filter("doc_id % 13 != 5").withColumn("text", F.expr(BEFORE))
        gone = docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("gone thean").alias("text")).filter("doc_id % 17 = -3")
        made = segments.LiveIndex.create(b.songs_of(old.select("doc_id", "text").unionByName(gone)), fresh_folder(spark, "live"), searched=searched)
        made.sync(b.document_songs(spark, sf_dir))
        _sessions[key] = files, made
    return _sessions[key][1]


def update_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of an index that was updated: those of one that is built anew."""
    return _shown(live_index(spark, sf_dir).search(ONE))


def update_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary and its counts after the update; an index that is searched has them too."""
    return live_index(spark, sf_dir, searched=False).vocabulary


def prepare_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prepare_song(b.document_songs(spark, sf_dir))


def hits_with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _lexical(ONE)(spark, sf_dir).drop("title")
    return store.hit_titles(hits, b.document_songs(spark, sf_dir), "unknown").select("n", "title")


QUERIES = {
    "prepare_song": prepare_song,
    "prepare_variants": lambda s, d: b.document_variants(s, d),
    "build_exact_index": lambda s, d: session(s, d).exact.drop("row"),
    "search_exact": _exact,
    "sort_exact": lambda s, d: _exact(s, d).select("n", "score"),
    "build_lexical_index": lambda s, d: session(s, d).index.select("ref", "term", "tf_title", "tf_content", "len_title", "len_content"),
    "search_lexical": _lexical(LEXICAL),
    "search_lexical_fallback": _lexical(FALLBACK),
    "search_fuzzy": _lexical(ONE),
    "search_lexical_stemmed": _lexical(LEXICAL, stem=search.stem_ru),
    "sort_lexical": lambda s, d: _lexical(ONE)(s, d).select("n", "score"),
    "search_unified": _unified(ONE),
    "union_exact_lexical": lambda s, d: _unified(LEXICAL)(s, d).select("n", "tier"),
    "except_exact": lexical_not_in_exact,
    "lexical_not_in_exact": lexical_not_in_exact,
    "ui_limit": lambda s, d: _unified(ONE, UI_LIMIT)(s, d).select("score", "tier"),
    "result_rank": result_rank,
    "dedupe_best_variant": dedupe_best_variant,
    "search_number": search_number,
    "search_session": search_session,
    "search_hit_titles": hits_with_titles,
    "build_substring_index": lambda s, d: session(s, d).dictionary,
    "fuzzy_terms": fuzzy_terms,
    "search_all": search_all,
    "search_all_exact": search_all_exact,
    "search_all_top": lambda s, d: search_all(s, d, UI_LIMIT).select("query_id", "rank", "tier", "score"),
    "update_index": update_index,
    "update_index_terms": update_index_terms,
}
#: Letters beyond ASCII become single unused ASCII characters, since this engine's distance counts bytes.
LETTERS = "translate({0}, 'àáâäçèéêëíîïñóôöùúûüß¿¡«»“”…–—’', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456')"
INDEX = {
    "tl": "SELECT ref, n::VARCHAR AS n, variantIndex, list_filter(string_split(lower(title), ' '), lambda w: w <> '') AS t, list_filter(string_split(lower(content), ' '), lambda w: w <> '') AS c FROM prepared",
    "tx": "SELECT ref, n, variantIndex, len(t) AS lt, len(c) AS lc, unnest(t) AS term, 0 AS f FROM tl UNION ALL SELECT ref, n, variantIndex, len(t), len(c), unnest(c), 1 FROM tl",
    "post": "SELECT ref, n, variantIndex, lt, lc, term, count(*) FILTER (WHERE f = 0) AS tft, count(*) FILTER (WHERE f = 1) AS tfc FROM tx GROUP BY ALL",
    "st": "SELECT count(*) AS docs, avg(len(t)) AS avt, avg(len(c)) AS avc FROM tl",
}


def _search_sql(query: str) -> dict[str, str]:
    *need, last = query.replace(",", "").lower().split()
    required = f"term IN ({', '.join(repr(x) for x in need)})" if need else "false"
    return {
        "terms": f"SELECT term, {required} AS req FROM (SELECT DISTINCT term FROM post) WHERE {required} OR (abs(length(term) - {len(last)}) <= 2 AND levenshtein({LETTERS.format('term')}, '{last}') <= 2)",
        "hit": "SELECT post.*, req FROM post JOIN terms USING (term)",
        "df": "SELECT term, count(*) AS df FROM hit GROUP BY term",
        "bm": """SELECT ref, n, variantIndex, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (10.0::DOUBLE * tft * 2.2 / (tft + 1.2 * (0.25 + 0.75 * lt / avt)) + tfc * 2.2::DOUBLE / (tfc + 1.2 * (0.25 + 0.75 * lc / avc)))) AS score,
          count(DISTINCT CASE WHEN req THEN term END) AS found FROM hit JOIN df USING (term), st GROUP BY ALL""",
        "allowed": f"SELECT * FROM bm WHERE found = {len(set(need))} OR NOT EXISTS (SELECT 1 FROM bm WHERE found = {len(set(need))})",
        "lex": "SELECT n, CAST(variantIndex AS INT) AS variantIndex, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY round(score, 6) DESC, variantIndex) AS r FROM allowed) WHERE r = 1",
    }


def _exact_sql(query: str) -> dict[str, str]:
    q = query.lower().replace(" ", "").replace(",", "")
    return {
        "es": f"SELECT n, CAST(variantIndex AS INT) AS variantIndex, title, CASE WHEN instr(titleFlat, '{q}') > 0 THEN 2 + 1.0::DOUBLE / instr(titleFlat, '{q}') WHEN instr(textFlat, '{q}') > 0 THEN 1.0::DOUBLE / instr(textFlat, '{q}') END AS score FROM flat",
        "ex": "SELECT n, variantIndex, title, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, variantIndex) AS r FROM es WHERE score IS NOT NULL) WHERE r = 1",
    }


def _all_sql() -> dict[str, str]:
    """Lexical and exact hits of all part names, as for one query."""
    return {
        "asked": "SELECT DISTINCT p_name AS query_id, string_split(lower(p_name), ' ') AS words FROM part WHERE length(p_name) >= 3",
        "need": "SELECT DISTINCT query_id, unnest(words[:-2]) AS term FROM asked",
        "needs": "SELECT query_id, len(list_distinct(words[:-2])) AS need FROM asked",
        "vocab": f"SELECT term, {LETTERS.format('term')} AS plain, count(*) AS df FROM post GROUP BY ALL",
        "lasts": "SELECT DISTINCT words[-1] AS word FROM asked",
        "fuzzy": "SELECT word, term, df FROM lasts JOIN vocab ON abs(length(term) - length(word)) <= 2 AND levenshtein(plain, word) <= 2",
        "terms": "SELECT query_id, term, df, bool_or(req) AS req FROM (SELECT query_id, term, df, true AS req FROM need JOIN vocab USING (term) UNION ALL SELECT query_id, term, df, false FROM asked JOIN fuzzy ON word = words[-1]) GROUP BY ALL",
        "bm": """SELECT query_id, ref, n, variantIndex, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (10.0::DOUBLE * tft * 2.2 / (tft + 1.2 * (0.25 + 0.75 * lt / avt)) + tfc * 2.2::DOUBLE / (tfc + 1.2 * (0.25 + 0.75 * lc / avc)))) AS score,
          count(*) FILTER (WHERE req) AS found FROM post JOIN terms USING (term), st GROUP BY ALL""",
        "allowed": "SELECT bm.* FROM bm JOIN needs USING (query_id) JOIN (SELECT query_id, max(found) AS most FROM bm GROUP BY 1) USING (query_id) WHERE most < need OR found = need",
        "lex": "SELECT query_id, n, CAST(variantIndex AS INT) AS variantIndex, round(score, 6) AS score FROM allowed QUALIFY row_number() OVER (PARTITION BY query_id, n ORDER BY round(score, 6) DESC, variantIndex) = 1",
        **_all_exact_sql("asked_flat"), "asked_flat": "SELECT query_id, array_to_string(words, '') AS needle FROM asked",
        "uni": "SELECT query_id, n, variantIndex, score, title, 'exact' AS matchType, 0 AS tier FROM ex UNION ALL SELECT query_id, n, variantIndex, score, '', 'lexical', 1 FROM lex WHERE (query_id, n) NOT IN (SELECT (query_id, n) FROM ex)",
    }


def _all_exact_sql(asked: str) -> dict[str, str]:
    return {
        "es": f"SELECT query_id, n, CAST(variantIndex AS INT) AS variantIndex, title, CASE WHEN instr(titleFlat, needle) > 0 THEN 2 + 1.0::DOUBLE / instr(titleFlat, needle) ELSE 1.0::DOUBLE / instr(textFlat, needle) END AS score FROM {asked} JOIN flat ON instr(textFlat, needle) > 0",
        "ex": "SELECT query_id, n, variantIndex, title, round(score, 6) AS score FROM es QUALIFY row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, variantIndex) = 1",
    }


ITEMS = r"""SELECT item_id AS query_id, replace(lower(trim(regexp_replace(regexp_replace(text, '[/\[\]()!?.,;:"''-]', ' ', 'g'), '\s+', ' ', 'g'))), ' ', '') AS needle FROM benchmark
  WHERE length(trim(regexp_replace(regexp_replace(text, '[/\[\]()!?.,;:"''-]', ' ', 'g'), '\s+', ' ', 'g'))) >= 3"""
FLAT = (*DOCS, "flat")
LEX = "SELECT n, variantIndex, score, '' AS title, 'lexical' AS matchType FROM lex"
UNI = "SELECT n, variantIndex, score, title, 'exact' AS matchType, 0 AS tier FROM ex UNION ALL SELECT n, variantIndex, score, '', 'lexical', 1 FROM lex WHERE n NOT IN (SELECT n FROM ex)"
BOTH = {**INDEX, **_search_sql(ONE), **_exact_sql(ONE), "uni": UNI}
ORACLE_SQL = {
    "prepare_song": sql(DOCS, "SELECT a.n, a.title, CASE WHEN b.c > 0 THEN a.content || ' ' || b.content ELSE a.content END AS content FROM prepared a JOIN (SELECT n, content, len(parts) AS c FROM prepared JOIN doc_variants USING (n, variantIndex) WHERE variantIndex = 1) b ON a.n = b.n WHERE variantIndex = 0"),
    "prepare_variants": sql(DOCS, "SELECT ref, n, title, content, CAST(variantIndex AS INT) AS variantIndex FROM prepared"),
    "build_exact_index": sql(FLAT, "SELECT n, title, CAST(variantIndex AS INT) AS variantIndex, titleFlat, textFlat FROM flat"),
    "search_exact": sql(FLAT, "SELECT n, variantIndex, score, title, 'exact' AS matchType FROM ex", **_exact_sql(EXACT)),
    "sort_exact": sql(FLAT, "SELECT n, score FROM ex", **_exact_sql(EXACT)),
    "build_lexical_index": sql(DOCS, "SELECT ref, term, tft AS tf_title, tfc AS tf_content, CAST(lt AS INT) AS len_title, CAST(lc AS INT) AS len_content FROM post", **INDEX),
    "search_lexical": sql(DOCS, LEX, **INDEX, **_search_sql(LEXICAL)),
    "search_lexical_fallback": sql(DOCS, LEX, **INDEX, **_search_sql(FALLBACK)),
    "search_fuzzy": sql(DOCS, LEX, **INDEX, **_search_sql(ONE)),
    "sort_lexical": sql(DOCS, "SELECT n, score FROM lex", **INDEX, **_search_sql(ONE)),
    "search_unified": sql(FLAT, "SELECT * FROM uni", **BOTH),
    "union_exact_lexical": sql(FLAT, "SELECT n, tier FROM uni", **INDEX, **_search_sql(LEXICAL), **_exact_sql(LEXICAL), uni=UNI),
    "except_exact": sql(FLAT, "SELECT n, variantIndex, score FROM uni WHERE tier = 1", **BOTH),
    "ui_limit": sql(FLAT, f"SELECT score, tier FROM uni ORDER BY tier, score DESC, title, n LIMIT {UI_LIMIT}", **BOTH),
    "result_rank": sql(FLAT, "SELECT n, row_number() OVER (ORDER BY tier, score DESC, n) AS place FROM uni", **BOTH),
    "dedupe_best_variant": sql(FLAT, "SELECT n, variantIndex, score FROM ex", **_exact_sql("the")),
    "search_number": "SELECT doc_id AS number, string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents WHERE doc_id = 42",
    "search_hit_titles": sql(DOCS, "SELECT lex.n, string_split(coalesce(text, ''), chr(10))[1] AS title FROM lex JOIN documents ON doc_id = lex.n::BIGINT", **INDEX, **_search_sql(ONE)),
}
ORACLE_SQL["lexical_not_in_exact"] = ORACLE_SQL["except_exact"]
ALL = {k: v for k, v in (INDEX | _all_sql()).items() if k not in ("asked_flat", "es", "ex", "uni")} | {k: _all_sql()[k] for k in ("asked_flat", "es", "ex", "uni")}
SHOWN = "SELECT n, variantIndex, score, title, matchType, tier, '{0}' AS query FROM ({1})"
ORACLE_SQL |= {
    "update_index": ORACLE_SQL["search_unified"],
    "update_index_terms": sql(DOCS, "SELECT term, count(*) AS df FROM post GROUP BY term", **INDEX),
    "build_substring_index": sql(FLAT, "SELECT gram, count(*) AS df FROM (SELECT DISTINCT n, variantIndex, unnest(list_transform(range(1, length(textFlat) + 1), lambda i: substr(textFlat || '  ', i, 3))) AS gram FROM flat) GROUP BY 1"),
    "fuzzy_terms": sql(DOCS, "SELECT word, term, df FROM fuzzy", **INDEX, **{k: ALL[k] for k in ("asked", "vocab", "lasts", "fuzzy")}),
    "search_all": sql(FLAT, "SELECT * FROM uni", **ALL),
    "search_all_exact": sql(FLAT, "SELECT query_id, n, variantIndex, title, score, 'exact' AS matchType FROM ex", items=ITEMS, **_all_exact_sql("items")),
    "search_all_top": sql(FLAT, "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC)::INT AS rank, tier, score FROM uni QUALIFY rank <= 7", **ALL),
    "search_session": " UNION ALL ".join("SELECT * FROM (" + SHOWN.format(q, sql(FLAT, "SELECT * FROM uni", **INDEX, **_search_sql(q), **_exact_sql(q), uni=UNI)) + ")" for q in (ONE, FALLBACK)),
}
