"""Substring, fuzzy full-text and unified search over songs (number, title, variants).

The index is a table: ``exact_index`` one row a variant, ``postings`` one row a (variant, term) with term
counts of both fields. ``SearchSession`` writes these with a substring index (``grams``) and a fuzzy one
(``edits``) and asks them, one query or a table of queries at a time (``ask``). The functions that take an
index and a query scan instead: the plain form of the same results, without anything written before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions.text import clean_text, flatten_text, lowered
from strophe.operators import ask, edits, grams, scan
from strophe.operators.ask import FUZZY, LISTED, MIN_QUERY, exact_score
from strophe.operators.ranking import best_of, top
from strophe.sources.workspace import materialize

# Fixed values.
HIT = "n string, variantIndex int, score double, title string, matchType string"
#: Bytes of an index's row group: small, so that a scan for few keys reads little.
ROW_GROUP = 4 << 20
#: What exact and lexical searches ask.
EXACT_TABLES, LEXICAL_TABLES = ("exact", "grams", "dictionary"), ("index", "vocabulary", "neighbourhoods", "stats")


def prepare_song(songs: DataFrame) -> DataFrame:
    """(n, title, content): all variants in one."""
    parts = F.transform(F.flatten(F.transform("variants", lambda v: v["body"])), lambda p: clean_text(p["content"]))
    return songs.select(F.col("number").alias("n"), clean_text(F.col("title")).alias("title"), F.array_join(parts, " ").alias("content"))


def prepare_variants(songs: DataFrame) -> DataFrame:
    """(ref, n, title, content, variantIndex): one row a variant; a song without variants has an empty one."""
    return _variants(songs).drop("raw_title")


def _variants(songs: DataFrame) -> DataFrame:
    rows = _bodies(songs)
    return rows.select(
        F.concat(F.col("number").cast("string"), F.lit(":"), F.col("variantIndex").cast("string")).alias("ref"), F.col("number").alias("n"),
        clean_text(F.col("title")).alias("title"), F.array_join(F.transform("body", lambda p: clean_text(p["content"])), " ").alias("content"), "variantIndex", F.col("title").alias("raw_title"),
    )


def _bodies(songs: DataFrame) -> DataFrame:
    """(number, title, variantIndex, body)."""
    empty = F.array_compact(F.array(F.lit(None).cast(songs.schema["variants"].dataType.elementType)))
    some = F.when(F.col("variants").isNull(), F.array(F.lit(None).cast(songs.schema["variants"].dataType.elementType))).otherwise(F.coalesce("variants", empty))
    rows = songs.select("number", "title", F.posexplode(some).alias("variantIndex", "v"))
    none = F.array_compact(F.array(F.lit(None).cast(rows.schema["v"].dataType["body"].dataType.elementType)))
    return rows.select("number", "title", "variantIndex", F.coalesce(F.col("v.body"), none).alias("body"))


def low_texts(songs: DataFrame) -> DataFrame:
    """(n, variantIndex, title, low_title, low_content): the texts in lower case, with their marks and white space."""
    content = F.array_join(F.transform("body", lambda p: p["content"]), "\n")
    rows = _bodies(songs).select("number", "variantIndex", F.coalesce("title", F.lit("")).alias("title"), content.alias("content"))
    return rows.select(F.col("number").cast("string").alias("n"), "variantIndex", "title", lowered(F.col("title")).alias("low_title"), lowered(F.col("content")).alias("low_content"))


def exact_index(songs: DataFrame) -> DataFrame:
    """(n, title, variantIndex, titleFlat, textFlat); the text starts with the title."""
    return flat_index(_variants(songs).select("n", F.coalesce("raw_title", F.lit("")).alias("title"), "variantIndex", F.col("title").alias("clean"), "content"))


def flat_index(rows: DataFrame) -> DataFrame:
    """The index of (n, title, variantIndex, clean, content) rows: a projection."""
    whole = F.concat_ws(" ", "clean", "content")
    return rows.select(F.col("n").cast("string").alias("n"), "title", "variantIndex", flatten_text(F.col("clean")).alias("titleFlat"), flatten_text(whole).alias("textFlat"))


def gate(spark: SparkSession, query: str | None) -> str | None:
    """The cleaned, lower-cased query, or null if it is too short. A literal: folded by the optimizer."""
    q = spark.range(1).select(F.lower(clean_text(F.lit(query).cast("string"))).alias("q")).first()["q"]
    return q if len(q) >= MIN_QUERY else None


def no_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HIT)


def search_exact(index: DataFrame, query: str | None, limit: int = 0) -> DataFrame:
    """Hits of ``query`` without its blanks, the best variant of each song, in order."""
    return top(_exact_hits(index, query), limit, *order_exact())


def _exact_hits(index: DataFrame, query: str | None) -> DataFrame:
    q = gate(index.sparkSession, query)
    if q is None:
        return no_hits(index.sparkSession)
    scored = index.select("n", F.col("variantIndex").cast("int").alias("variantIndex"), exact_score(F.lit(q.replace(" ", ""))).alias("score"), "title", F.lit("exact").alias("matchType"))
    return best_of(scored.filter(F.col("score").isNotNull()), ["n"], F.desc("score"), F.col("variantIndex"))


def order_exact() -> tuple[Column, ...]:
    """By score, then by title in Russian order, then by number."""
    return F.desc("score"), F.collate("title", "ru"), F.col("n")


def postings(songs: DataFrame, stem: Callable[[Column], Column] | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(ref, n, variantIndex, term, tf_title, tf_content, len_title, len_content)."""
    return postings_of(prepare_variants(songs), stem, stopwords)


def postings_of(docs: DataFrame, stem: Callable[[Column], Column] | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), " "), lambda w: (w != "") & ~w.isin(*stopwords) if stopwords else w != "")
    rows = docs.select("ref", F.col("n").cast("string").alias("n"), "variantIndex", words("title").alias("t"), words("content").alias("c"))
    sized = rows.withColumns({"len_title": F.size("t"), "len_content": F.size("c")})
    mark = lambda f: lambda w: F.struct(w.alias("term"), F.lit(f).alias("field"))
    each = sized.select("ref", "n", "variantIndex", "len_title", "len_content", F.explode(F.concat(F.transform("t", mark(0)), F.transform("c", mark(1)))).alias("x"))
    term = stem(F.col("x.term")) if stem else F.col("x.term")
    keyed = each.select("ref", "n", "variantIndex", "len_title", "len_content", term.alias("term"), "x.field")
    return keyed.groupBy("ref", "n", "variantIndex", "len_title", "len_content", "term").agg(F.sum((F.col("field") == 0).cast("int")).alias("tf_title"), F.sum((F.col("field") == 1).cast("int")).alias("tf_content"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row: documents and mean field lengths; ``docs`` has one row a variant."""
    size = lambda c: F.size(F.filter(F.split(F.lower(F.col(c)), " "), lambda w: w != ""))
    return docs.select(size("title").alias("t"), size("content").alias("c")).agg(F.count("*").alias("docs"), F.avg("t").alias("avg_title"), F.avg("c").alias("avg_content"))


def vocabulary_of(index: DataFrame) -> DataFrame:
    """(term, df): in how many variants each term stands."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def term_counts(songs: DataFrame, stem: Callable[[Column], Column] | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``vocabulary_of`` the postings of ``songs``, without these: a variant's different words are counted where they are read."""
    if stem:
        return vocabulary_of(postings(songs, stem, stopwords))
    counts = scan.counts_of(low_texts(songs))
    return (counts.filter(~F.col("term").isin(*stopwords)) if stopwords else counts).groupBy("term").agg(F.sum("df").alias("df"))


def matched_terms(vocabulary: DataFrame, terms: list[str], fuzzy: int, transposed: bool = False) -> DataFrame:
    """(term, df, required) of the vocabulary: all query terms but the last as they are, words near the last.

    ``transposed`` counts two swapped letters as one edit.
    """
    *need, last = terms
    near = F.length("term").between(len(last) - fuzzy, len(last) + fuzzy) & F.levenshtein("term", F.lit(last), fuzzy).between(0, fuzzy)
    if transposed:
        swaps = {last[:k] + last[k + 1] + last[k] + last[k + 2 :] for k in range(len(last) - 1)}
        for s in sorted(swaps):
            near = near | (F.length("term").between(len(s) - fuzzy + 1, len(s) + fuzzy - 1) & F.levenshtein("term", F.lit(s), fuzzy - 1).between(0, fuzzy - 1))
    required = F.col("term").isin(*need) if need else F.lit(False)
    return vocabulary.filter(required | near).select("term", "df", required.alias("required"))


def bm25(index: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(ref, n, variantIndex, score, required_found): boosted BM25 of both fields over ``terms``.

    Up to ``LISTED`` terms become a filter of the scan and a small broadcast; more are joined by shuffle.
    """
    total = stats.first()  # one row
    some = terms.limit(LISTED + 1).collect()
    if len(some) <= LISTED:
        found = index.sparkSession.createDataFrame(some, terms.schema)
        hits = index.filter(F.col("term").isin(*[r["term"] for r in some])).join(F.broadcast(found), "term")
    else:
        hits = index.join(terms, "term")
    scored = hits.withColumn("s", ask.weight(total, F.col("df")))
    return scored.groupBy("ref", "n", "variantIndex").agg(F.sum("s").alias("score"), F.countDistinct(F.when(F.col("required"), F.col("term"))).alias("required_found"))


def search_lexical(index: DataFrame, stats: DataFrame, query: str | None, limit: int = 0, **kw) -> DataFrame:
    """``lexical_hits``, in order."""
    return top(lexical_hits(index, stats, query, **kw), limit, *order_lexical())


def lexical_hits(
    index: DataFrame, stats: DataFrame, query: str | None, stem: Callable[[Column], Column] | None = None, fuzzy: int = FUZZY, transposed: bool = False, vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Hits of the last term, with up to ``fuzzy`` edits, in variants that hold all other terms; where no
    variant holds them all, hits of any term. ``+ * ~ ^`` are letters like any other."""
    spark = index.sparkSession
    q = gate(spark, query)
    if q is None:
        return no_hits(spark)
    terms = q.split()
    if stem:
        terms = [r["t"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "k int, t string").withColumn("t", stem(F.col("t"))).orderBy("k").collect()]
    scored = materialize(bm25(index, stats, matched_terms(vocabulary_of(index) if vocabulary is None else vocabulary, terms, fuzzy, transposed)), "scored")
    strict = scored.filter(F.col("required_found") == len(set(terms[:-1])))
    any_strict = strict.select(F.lit(1).alias("one")).limit(1)
    relaxed = scored.withColumn("one", F.lit(1)).join(F.broadcast(any_strict), "one", "left_anti").drop("one")
    best = best_of(strict.unionByName(relaxed), ["n"], F.desc(F.round("score", 6)), F.col("variantIndex"))
    return best.select("n", F.col("variantIndex").cast("int").alias("variantIndex"), "score", F.lit("").alias("title"), F.lit("lexical").alias("matchType"))


def order_lexical() -> tuple[Column, ...]:
    return F.desc(F.round("score", 6)), F.col("n")


def search_unified(exact: DataFrame, index: DataFrame, stats: DataFrame, query: str | None, limit: int = 0, **kw) -> DataFrame:
    """Exact hits, then lexical hits of songs that have no exact one; ``tier`` tells them apart."""
    first = _exact_hits(exact, query)
    second = lexical_hits(index, stats, query, **kw).join(first.select("n"), "n", "left_anti")
    both = first.withColumn("tier", F.lit(0)).unionByName(second.withColumn("tier", F.lit(1)))
    return top(both, limit, F.col("tier"), F.desc(F.round("score", 6)), F.collate("title", "ru"), F.col("n"))


def search_number(songs: DataFrame, query: str) -> DataFrame:
    """The song that a query of digits names; empty for 0, unknown numbers and other queries."""
    q = query.strip()
    wanted = int(q) if q.isascii() and q.isdigit() else 0
    return songs.filter((F.col("number") == wanted) & F.lit(wanted != 0))


def asked_once(spark: SparkSession, query: str | None) -> DataFrame:
    """One query as a table of queries."""
    return ask.prepared(spark.createDataFrame([(0, query)], "query_id int, query string"))


class SearchSession:
    """The indexes, each written once under ``path`` when it is first asked for, and read by every query.

    Few queries that no written index answers are answered by one pass over the texts (``scan``).
    """

    def __init__(self, songs: DataFrame, path: str, stem: Callable[[Column], Column] | None = None, stopwords: tuple[str, ...] = (), edits: int = FUZZY) -> None:
        self.songs, self.path, self.stem, self.stopwords, self.edits = songs, path, stem, stopwords, edits

    def _written(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """``df`` as a table; sorted by ``by`` over ranges, so that a search for few keys skips row groups."""
        if by:
            df = materialize(df, name).repartitionByRange(*by).sortWithinPartitions(*by)
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{name}")

    @cached_property
    def exact(self) -> DataFrame:
        """``exact_index`` and a number for each of its rows."""
        return self._written(exact_index(self.songs).withColumn("row", F.monotonically_increasing_id()), "exact")

    @cached_property
    def grams(self) -> DataFrame:
        return self._written(grams.postings(self.exact.select("row", F.col("textFlat").alias("text"))), "grams", "gram", "block")

    @cached_property
    def dictionary(self) -> DataFrame:
        return self._written(grams.counts(self.grams), "gram-counts")

    @cached_property
    def index(self) -> DataFrame:
        rows = postings_of(prepare_variants(self.songs).repartition("ref"), self.stem, self.stopwords)
        return self._written(rows, "postings", "term", "ref")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._written(vocabulary_of(self.index), "vocabulary", "term")

    @cached_property
    def neighbourhoods(self) -> DataFrame:
        return self._written(edits.neighbourhoods(self.vocabulary, self.edits), "neighbourhoods", "key", "term")

    @cached_property
    def stats(self) -> DataFrame:
        return self._written(statistics(prepare_variants(self.songs)), "statistics")

    @property
    def exact_indexes(self) -> ask.Indexes:
        return ask.Indexes(self.exact, self.grams, self.dictionary, None, None, None, None)

    @property
    def indexes(self) -> ask.Indexes:
        return ask.Indexes(self.exact, self.grams, self.dictionary, self.index, self.vocabulary, self.neighbourhoods, self.stats)

    # asking

    def _few(self, asked: DataFrame, *needed: str) -> list | None:
        """The queries if they are few and some index that they need is not written: then the texts are read for them."""
        if self.stem or self.stopwords or all(k in self.__dict__ for k in needed):
            return None
        return scan.few(asked)

    def _exact(self, asked: DataFrame) -> DataFrame:
        few = self._few(asked, *EXACT_TABLES)
        if few is None:
            return ask.exact(asked, self.exact_indexes)
        return ask.shown_exact(scan.exact_hits(scan.read(low_texts(self.songs), few, lexical=False), few, asked.schema["query_id"]))

    def _lexical(self, asked: DataFrame, **kw) -> DataFrame:
        few = self._few(asked, *LEXICAL_TABLES)
        if few is None:
            return ask.lexical(asked, self.indexes, stem=self.stem, **kw)
        rows = scan.read(low_texts(self.songs), few, exact=False, **kw)
        return ask.shown_lexical(scan.lexical_hits(rows, few, asked.schema["query_id"], **kw))

    def _unified(self, asked: DataFrame, limit: int, **kw) -> DataFrame:
        few, ids = self._few(asked, *EXACT_TABLES, *LEXICAL_TABLES), asked.schema["query_id"]
        if few is None:
            return ask.unified(asked, self.indexes, limit, stem=self.stem, **kw)
        rows = scan.read(low_texts(self.songs), few, **kw)
        first = materialize(ask.shown_exact(scan.exact_hits(rows, few, ids)), "exact-hits")
        if limit > 0:
            full = {r["query_id"] for r in ask.filled(first, limit).collect()}
            few = [r for r in few if r["query_id"] not in full]
            if not few:
                return first.withColumn("tier", F.lit(0))
        return ask.tiers(first, ask.shown_lexical(scan.lexical_hits(rows, few, ids, **kw)))

    def search_exact(self, query: str | None, limit: int = 0) -> DataFrame:
        return top(self._exact(asked_once(self.songs.sparkSession, query)).drop("query_id"), limit, *order_exact())

    def search_lexical(self, query: str | None, limit: int = 0, **kw) -> DataFrame:
        return top(self._lexical(asked_once(self.songs.sparkSession, query), **kw).drop("query_id"), limit, *order_lexical())

    def search(self, query: str | None, limit: int = 0, **kw) -> DataFrame:
        hits = self._unified(asked_once(self.songs.sparkSession, query), limit, **kw).drop("query_id")
        return top(hits, limit, *ask.order(hits))

    def search_all(self, queries: DataFrame, limit: int = 0, **kw) -> DataFrame:
        """The hits of every row of ``queries``, (query_id, query), as ``search`` finds them; with a ``limit``
        the first ones of each query and their rank."""
        hits = self._unified(materialize(ask.prepared(queries), "queries"), limit, **kw)
        return ask.first(hits, limit) if limit > 0 else hits

    def search_all_exact(self, queries: DataFrame, limit: int = 0) -> DataFrame:
        """As ``search_all``, exact hits alone."""
        hits = self._exact(materialize(ask.prepared(queries), "queries"))
        return ask.first(hits, limit) if limit > 0 else hits


# Endings of the published Snowball stemmer for Russian.
_GERUND = (("авшись", "авши", "ав", "явшись", "явши", "яв"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив"))
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_VERB = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"),
)
_NOUN = ("иями", "ями", "ами", "иях", "иям", "ием", "ией", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")
_VOWELS = "аеиоуыэюя"


def _without(word: str, start: int, plain: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """``word`` without the longest ending at or after ``start``; those of ``after_a`` follow а or я."""
    found = [e for e in plain if word.endswith(e) and len(word) - len(e) >= start]
    found += [e for e in after_a if word.endswith(e) and len(word) - len(e) - 1 >= start and word[-len(e) - 1] in "ая"]
    return word[: -len(max(found, key=len))] if found else None


def stem_word(word: str) -> str:
    """The published Snowball algorithm: endings in the region after the first vowel."""
    word = word.replace("ё", "е")
    rv = next((k + 1 for k, c in enumerate(word) if c in _VOWELS), len(word))
    region, at = [], 0
    for _ in range(2):
        at = next((k + 1 for k in range(max(at, 1), len(word)) if word[k] not in _VOWELS and word[k - 1] in _VOWELS), len(word))
        region.append(at)
    r2 = region[1]
    gerund = _without(word, rv, _GERUND[1], tuple(e[1:] for e in _GERUND[0] if e[0] == "а"))
    if gerund is None:
        reflexive = _without(word, rv, ("ся", "сь"))
        word = word if reflexive is None else reflexive
        adjective = _without(word, rv, _ADJECTIVE)
        if adjective is not None:
            participle = _without(adjective, rv, _PARTICIPLE[1], _PARTICIPLE[0])
            word = adjective if participle is None else participle
        else:
            rest = _without(word, rv, _VERB[1], _VERB[0])
            rest = _without(word, rv, _NOUN) if rest is None else rest
            word = word if rest is None else rest
    else:
        word = gerund
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    derived = _without(word, r2, ("ост", "ость"))
    word = word if derived is None else derived
    if word.endswith("нн") and len(word) - 1 >= rv:
        return word[:-1]
    superlative = _without(word, rv, ("ейш", "ейше"))
    if superlative is not None:
        return superlative[:-1] if superlative.endswith("нн") else superlative
    return word[:-1] if word.endswith("ь") and len(word) - 1 >= rv else word


@F.pandas_udf(T.StringType())
def stem_ru(words: pd.Series) -> pd.Series:
    """Each distinct word of a batch is stemmed once."""
    return words.map({w: stem_word(w) for w in words.dropna().unique()})
