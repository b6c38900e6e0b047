"""Set-at-a-time search: a table of queries in, the hits of all of them out.

A query's needle, its required words and its last, fuzzy one are columns. All needles are answered by one
join with the substring index, all words by one join with the postings, so a thousand queries read each
index once. A small set of queries also knows few enough grams, terms and texts to become filters of the
scans (``LISTED``), which then skip the row groups without them; a larger one is joined.

Queries: (query_id, query). Ids must differ; rows with a null id take no part; null, blank and too short
queries have no hits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.text import clean_text
from strophe.operators import edits, grams
from strophe.operators.ranking import best_of
from strophe.sources.workspace import materialize

# Fixed values.
MIN_QUERY = 3
FUZZY = 2
TITLE_BOOST, CONTENT_BOOST = 10.0, 1.0
TITLE_BASE = 2.0
K1, B = 1.2, 0.75

#: Values that go into a scan's filter, and rows that are broadcast.
LISTED, SMALL = 2000, 100_000


@dataclass(frozen=True)
class Indexes:
    """The written tables that searches ask."""

    exact: DataFrame  # row, n, title, variantIndex, titleFlat, textFlat
    grams: DataFrame  # gram, block, members
    dictionary: DataFrame  # gram, df
    postings: DataFrame  # ref, n, variantIndex, term, tf_title, tf_content, len_title, len_content
    vocabulary: DataFrame  # term, df
    neighbourhoods: DataFrame  # key, term
    statistics: DataFrame  # docs, avg_title, avg_content


def exact_score(needle: Column) -> Column:
    """Above 2 for a hit in the title, at most 1 in the text, null without one; earlier is higher."""
    return score_of(F.instr("titleFlat", needle), F.instr("textFlat", needle))


def score_of(in_title: Column, in_text: Column) -> Column:
    """``exact_score`` of the places, from 1, in the title and the text."""
    return F.when(in_title > 0, TITLE_BASE + 1 / in_title).when(in_text > 0, 1 / in_text)


def prepared(queries: DataFrame) -> DataFrame:
    """(query_id, q, needle) of the queries that are long enough."""
    q = F.lower(clean_text(F.col("query").cast("string")))
    rows = queries.filter("query_id is not null").select("query_id", q.alias("q"))
    return rows.filter(F.length("q") >= MIN_QUERY).select("query_id", "q", F.replace("q", F.lit(" "), F.lit("")).alias("needle"))


def listed(wanted: DataFrame, key: str) -> tuple[list | None, bool]:
    """The different values of ``key`` in the written ``wanted`` if they are few, and whether its rows are few enough to broadcast."""
    rows = wanted.select(key).limit(LISTED + 1).collect()
    if len(rows) <= LISTED:
        return list({r[0] for r in rows}), True
    some = [r[0] for r in wanted.select(key).distinct().limit(LISTED + 1).collect()]
    return some if len(some) <= LISTED else None, wanted.limit(SMALL + 1).count() <= SMALL


def met(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``table`` joined with the written ``wanted`` on ``key``.

    Few different keys become a filter of the scan, few rows a broadcast of counted size; more are joined by
    a shuffle.
    """
    some, small = listed(wanted, key)
    return (table if some is None else table.filter(F.col(key).isin(some))).join(F.broadcast(wanted) if small else wanted, key)


def exact_hits(asked: DataFrame, ix: Indexes) -> DataFrame:
    """(query_id, n, variantIndex, score, title): the best variant of each song that holds the needle.

    ``asked``: (query_id, needle). Each different needle is looked up once.
    """
    needles = asked.select("needle").distinct()
    picks = materialize(grams.picked(needles, ix.dictionary), "picked-grams")
    some, small = listed(picks, "gram")
    index = ix.grams if some is None else ix.grams.filter(F.col("gram").isin(some))
    found = materialize(grams.candidates(index, F.broadcast(picks) if small else picks), "candidates")
    scored = met(ix.exact, found, "row").withColumn("score", exact_score(F.col("needle"))).filter("score is not null")
    hits = scored.select("needle", "n", F.col("variantIndex").cast("int").alias("variantIndex"), "score", "title")
    best = best_of(hits, ["needle", "n"], F.desc("score"), F.col("variantIndex"))
    return best.join(asked.select("query_id", "needle"), "needle").select("query_id", "n", "variantIndex", "score", "title")


def query_terms(asked: DataFrame, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, term, last) of (query_id, q)."""
    words = F.filter(F.split("q", " "), lambda w: w != "")
    each = asked.select("query_id", F.size(words).alias("n"), F.posexplode(words).alias("at", "term"))
    return each.select("query_id", (stem(F.col("term")) if stem else F.col("term")).alias("term"), (F.col("at") == F.col("n") - 1).alias("last"))


def matched(terms: DataFrame, ix: Indexes, fuzzy: int = FUZZY, transposed: bool = False) -> DataFrame:
    """(query_id, term, df, required): terms of the vocabulary that answer each query.

    All words but the last as they are, which are required, and the words near the last one.
    """
    need = terms.filter("not last").select("query_id", "term", F.lit(True).alias("required"))
    lasts = terms.filter("last").select("query_id", F.col("term").alias("word"))
    keys = materialize(edits.keys_of(lasts.select("word").distinct(), fuzzy, transposed), "remainders")
    some, small = listed(keys, "key")
    index = ix.neighbourhoods if some is None else ix.neighbourhoods.filter(F.col("key").isin(some))
    keys = F.broadcast(keys) if small else keys
    near = lasts.join(edits.near_terms(index, keys, fuzzy, transposed), "word").select("query_id", "term", F.lit(False).alias("required"))
    wanted = need.unionByName(near).groupBy("query_id", "term").agg(F.max("required").alias("required"))
    return met(ix.vocabulary, materialize(wanted, "wanted-terms"), "term")


def weight(total, df: Column) -> Column:
    """Boosted BM25 of a posting: both fields of a term; ``total`` is the row of the statistics."""
    idf = F.log(1 + (F.lit(total["docs"]) - df + 0.5) / (df + 0.5))

    def part(tf: str, length: str, mean: float | None, boost: float) -> Column:
        norm = (1 - B) + B * F.col(length) / F.lit(float(mean or 1.0) or 1.0)
        return boost * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * norm)

    return idf * (part("tf_title", "len_title", total["avg_title"], TITLE_BOOST) + part("tf_content", "len_content", total["avg_content"], CONTENT_BOOST))


def lexical_hits(asked: DataFrame, ix: Indexes, stem: Callable[[Column], Column] | None = None, fuzzy: int = FUZZY, transposed: bool = False) -> DataFrame:
    """(query_id, n, variantIndex, score): variants that hold all required words of a query, and any word of
    it where none holds them all; the best variant of each song. The postings are read once."""
    terms = query_terms(asked, stem)
    wanted = materialize(matched(terms, ix, fuzzy, transposed), "matched-terms")
    hits = met(ix.postings, wanted, "term").withColumn("s", weight(ix.statistics.first(), F.col("df")))
    found = F.sum(F.col("required").cast("int")).alias("required_found")
    scored = materialize(hits.groupBy("query_id", "ref", "n", "variantIndex").agg(F.sum("s").alias("score"), found), "scored")
    need = terms.groupBy("query_id").agg(F.count_distinct(F.when(~F.col("last"), F.col("term"))).alias("need"))
    most = scored.groupBy("query_id").agg(F.max("required_found").alias("most")).join(need, "query_id")
    bound = most.select("query_id", F.when(F.col("most") == F.col("need"), F.col("need")).otherwise(0).alias("bound"))
    allowed = scored.join(bound, "query_id").filter(F.col("required_found") >= F.col("bound"))
    best = best_of(allowed, ["query_id", "n"], F.desc(F.round("score", 6)), F.col("variantIndex"))
    return best.select("query_id", "n", F.col("variantIndex").cast("int").alias("variantIndex"), "score")


def exact(asked: DataFrame, ix: Indexes) -> DataFrame:
    """Exact hits in the form of results."""
    return shown_exact(exact_hits(asked, ix))


def shown_exact(hits: DataFrame) -> DataFrame:
    return hits.withColumn("matchType", F.lit("exact"))


def lexical(asked: DataFrame, ix: Indexes, **kw) -> DataFrame:
    """Lexical hits in the form of results."""
    return shown_lexical(lexical_hits(asked, ix, **kw))


def shown_lexical(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"title": F.lit(""), "matchType": F.lit("lexical")})


def unified(asked: DataFrame, ix: Indexes, limit: int = 0, **kw) -> DataFrame:
    """Exact hits, then lexical hits of songs that have no exact one for the query; ``tier`` tells them apart.

    With a ``limit`` queries with as many exact hits need no lexical ones, and their postings are not read.
    """
    first = materialize(exact(asked, ix), "exact-hits")
    if limit > 0:
        asked = materialize(asked.join(filled(first, limit), "query_id", "left_anti"), "unfilled")
        if not asked.limit(1).count():
            return first.withColumn("tier", F.lit(0))
    return tiers(first, lexical(asked, ix, **kw))


def filled(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id) of the queries with ``limit`` hits or more."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hits")).filter(F.col("hits") >= limit).select("query_id")


def tiers(first: DataFrame, second: DataFrame) -> DataFrame:
    """The written exact hits, then lexical hits of songs without one."""
    known = first.select("query_id", "n")
    rest = second.join(F.broadcast(known) if known.limit(SMALL + 1).count() <= SMALL else known, ["query_id", "n"], "left_anti")
    return first.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))


def order(hits: DataFrame) -> tuple[Column, ...]:
    """By tier, score, title in Russian order, number; exact and lexical hits alone are ordered alike."""
    tier = (F.col("tier"),) if "tier" in hits.columns else ()
    return (*tier, F.desc(F.round("score", 6)), F.collate("title", "ru"), F.col("n"))


def first(hits: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` hits of each query with their ``rank``; tasks pass on no more than that of a query."""
    from pyspark.sql import Window as W

    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order(hits))).cast("int"))
    return ranked.filter(F.col("rank") <= limit)
