"""Search indexes that follow their songs: segments, tombstones, and tables that are merged when read.

An update writes one segment with the indexes of the songs that are new or changed, and the numbers whose
rows in earlier segments no longer count. Counts that scores depend on are kept as differences (how many
variants a term has gained or lost, how many words), so merged they are those of a rebuild. What is read is
the union of the segments without what a tombstone covers. Compaction joins segments into one; a tombstone
keeps the number of the segment that it came with, so it never covers later rows.

Every change becomes visible by one appended row set in ``commits``; readers take the latest version, and a
segment whose writing failed is never named there. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import ask, edits, grams, search
from strophe.operators.ask import FUZZY, SMALL
from strophe.operators.ranking import top
from strophe.sources.workspace import materialize

COMMIT = "version long, segment long"
TABLES = {
    "exact": "n string, title string, variantIndex int, titleFlat string, textFlat string, row long", "grams": "gram string, block long, members array<smallint>", "gram-counts": "gram string, df long",
    "postings": "ref string, n string, variantIndex int, len_title int, len_content int, term string, tf_title long, tf_content long", "terms": "term string, df long",
    "neighbourhoods": "key long, term string", "sizes": "docs long, title long, content long", "gone": "n string, below long",
}
#: Rows of a segment are numbered from the segment's number times this.
ROWS = 1 << 46


class LiveIndex:
    """The indexes under ``path``. Songs: (number, title, variants), numbers differ.

    ``searched=False`` keeps the songs and the counts of their terms alone, for ``vocabulary``.
    """

    def __init__(self, spark: SparkSession, path: str, stem: Callable[[Column], Column] | None = None, stopwords: tuple[str, ...] = (), fuzzy: int = FUZZY, searched: bool = True) -> None:
        self.spark, self.path, self.stem, self.stopwords, self.fuzzy, self.searched = spark, path.rstrip("/"), stem, stopwords, fuzzy, searched

    # versions

    @classmethod
    def create(cls, songs: DataFrame, path: str, **kw) -> LiveIndex:
        """A new index of ``songs`` in one segment."""
        made = cls(songs.sparkSession, path, **kw)
        made._commit(0, [made._write(songs, 0, None)])
        return made

    def _commit(self, version: int, segments: list[int]) -> None:
        rows = self.spark.createDataFrame([(version, s) for s in segments], COMMIT).coalesce(1)
        rows.write.mode("append").parquet(f"{self.path}/commits")

    def state(self) -> tuple[int, list[int]]:
        """The latest version and its segments, the oldest first."""
        commits = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits")
        rows = commits.join(commits.agg(F.max("version").alias("version")), "version").select("version", "segment").collect()  # a row for each segment
        return rows[0]["version"], sorted(r["segment"] for r in rows)

    # reading

    def _read(self, name: str, segments: list[int]) -> DataFrame:
        """The tables ``name`` of the segments, with ``segment``."""
        each = [self._one(name, s).withColumn("segment", F.lit(s).cast("long")) for s in segments]
        return reduce(DataFrame.unionByName, each)

    def _one(self, name: str, segment: int) -> DataFrame:
        reader = self.spark.read.schema(TABLES[name]) if name in TABLES else self.spark.read
        return reader.parquet(f"{self.path}/{name}/{segment}")

    def _alive(self, name: str, segments: list[int], every: list[int]) -> DataFrame:
        """Rows of the ``segments`` that no tombstone of ``every`` segment covers."""
        rows = self._read(name, segments)
        if every == segments[:1]:
            return rows.drop("segment")  # one segment has nothing to cover
        gone = self._read("gone", every).groupBy("n").agg(F.max("below").alias("_below"))
        gone = F.broadcast(gone) if gone.limit(SMALL + 1).count() <= SMALL else gone
        return rows.join(gone, "n", "left").filter(F.col("_below").isNull() | (F.col("segment") >= F.col("_below"))).select([c for c in rows.columns if c != "segment"])

    def songs(self) -> DataFrame:
        """The songs as they are now."""
        segments = self.state()[1]
        return self._alive("songs", segments, segments).drop("n", "hash")

    @property
    def indexes(self) -> ask.Indexes:
        """The merged tables of the latest version."""
        segments = self.state()[1]
        total = self._read("sizes", segments).agg(F.sum("docs").alias("docs"), F.sum("title").alias("t"), F.sum("content").alias("c"))
        statistics = total.select("docs", (F.col("t") / F.col("docs")).alias("avg_title"), (F.col("c") / F.col("docs")).alias("avg_content"))
        return ask.Indexes(
            exact=self._alive("exact", segments, segments), grams=self._read("grams", segments).drop("segment"), dictionary=self._summed("gram-counts", "gram", segments),
            postings=self._alive("postings", segments, segments), vocabulary=self._summed("terms", "term", segments), neighbourhoods=self._read("neighbourhoods", segments).drop("segment"), statistics=statistics,
        )

    @property
    def vocabulary(self) -> DataFrame:
        """(term, df) of the latest version."""
        return self._summed("terms", "term", self.state()[1])

    def _summed(self, name: str, key: str, segments: list[int]) -> DataFrame:
        rows = self._read(name, segments)
        return rows.groupBy(key).agg(F.sum("df").alias("df")).filter("df > 0") if len(segments) > 1 else rows.drop("segment")

    # writing

    def _table(self, df: DataFrame, name: str, segment: int, *by: str) -> None:
        if by:
            df = materialize(df, name).repartitionByRange(*by).sortWithinPartitions(*by)
        df.write.mode("overwrite").option("parquet.block.size", search.ROW_GROUP).parquet(f"{self.path}/{name}/{segment}")

    def _postings(self, songs: DataFrame) -> DataFrame:
        return search.postings_of(search.prepare_variants(songs).repartition("ref"), self.stem, self.stopwords)

    def _sizes(self, songs: DataFrame) -> DataFrame:
        words = lambda c: F.sum(F.size(F.filter(F.split(F.lower(F.col(c)), " "), lambda w: w != "")))
        return search.prepare_variants(songs).agg(F.count("*").alias("docs"), F.coalesce(words("title"), F.lit(0)).alias("title"), F.coalesce(words("content"), F.lit(0)).alias("content"))

    def _write(self, songs: DataFrame, segment: int, before: tuple[list[int], DataFrame, DataFrame] | None) -> int:
        """The tables of a segment; ``before``: earlier segments, the numbers that they lose, and those songs as they were."""
        kept = songs.select("number", "title", "variants", F.col("number").cast("string").alias("n"), digest("title", "variants").alias("hash"))
        self._table(kept, "songs", segment)
        own = self._one("songs", segment)
        if not self.searched:
            return self._counted(own, segment, before)
        self._table(search.exact_index(own).withColumn("row", F.monotonically_increasing_id() + segment * ROWS), "exact", segment)
        self._grams(segment)
        self._table(self._postings(own), "postings", segment, "term", "ref")
        terms, sizes = search.vocabulary_of(self._one("postings", segment)), self._sizes(own)
        gone = self.spark.createDataFrame([], "n string, below long")
        if before:
            earlier, numbers, old = before
            lost = search.vocabulary_of(self._postings(old))
            terms = terms.unionByName(lost.withColumn("df", -F.col("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0")
            sizes = sizes.unionByName(self._sizes(old).select(*[(-F.col(c)).alias(c) for c in ("docs", "title", "content")]))
            gone = numbers.select(F.col("number").cast("string").alias("n"), F.lit(segment).cast("long").alias("below"))
        self._table(terms, "terms", segment, "term")
        new = self._one("terms", segment)
        known = self._read("terms", before[0]).select("term").distinct() if before else None
        self._table(edits.neighbourhoods(new.join(known, "term", "left_anti") if before else new, self.fuzzy), "neighbourhoods", segment, "key", "term")
        self._table(sizes, "sizes", segment)
        self._table(gone, "gone", segment)
        return segment

    def _counted(self, own: DataFrame, segment: int, before: tuple[list[int], DataFrame, DataFrame] | None) -> int:
        """The tables of a segment that keeps counts alone: no postings are made for them."""
        terms, gone = search.term_counts(own, self.stem, self.stopwords), self.spark.createDataFrame([], "n string, below long")
        if before:
            lost = search.term_counts(before[2], self.stem, self.stopwords).withColumn("df", -F.col("df"))
            terms = terms.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0")
            gone = before[1].select(F.col("number").cast("string").alias("n"), F.lit(segment).cast("long").alias("below"))
        self._table(terms, "terms", segment)
        self._table(gone, "gone", segment)
        return segment

    def _grams(self, segment: int) -> None:
        exact = self._one("exact", segment)
        self._table(grams.postings(exact.select("row", F.col("textFlat").alias("text"))), "grams", segment, "gram", "block")
        self._table(grams.counts(self._one("grams", segment)), "gram-counts", segment)

    def update(self, songs: DataFrame, removed: DataFrame | None = None, most: int = 8) -> int:
        """New and changed songs in, ``removed`` numbers out; the new version. More than ``most`` segments
        are compacted: all but the oldest become one."""
        version, segments = self.state()
        numbers = songs.select("number")
        if removed is not None:
            numbers = numbers.unionByName(removed.select(F.col("number").cast("long").alias("number")))
        numbers = materialize(numbers.distinct(), "changed-numbers")
        # songs as they were, of the changed numbers alone
        old = materialize(self.songs().join(numbers, "number", "left_semi"), "songs-before")
        self._commit(version + 1, [*segments, self._write(songs, version + 1, (segments, numbers, old))])
        return self.compact(segments[1:] + [version + 1]) if len(segments) + 1 > most else version + 1

    def sync(self, songs: DataFrame, most: int = 8) -> int:
        """Make the index that of ``songs``: only what differs is written; the version, the same without a difference."""
        version, segments = self.state()
        held = self._alive("songs", segments, segments).select("number", F.col("hash").alias("_held"))
        both = songs.select("number", digest("title", "variants").alias("_now")).join(held, "number", "full")
        unlike = materialize(both.filter(~F.col("_now").eqNullSafe(F.col("_held"))), "unlike")  # numbers and digests, no texts
        if not unlike.limit(1).count():
            return version
        changed = songs.join(unlike.filter("_now is not null").select("number"), "number", "left_semi")
        return self.update(changed.select("number", "title", "variants"), unlike.filter("_now is null").select("number"), most)

    def compact(self, segments: list[int] | None = None) -> int:
        """``segments``, by default all of them, as one; the new version."""
        version, every = self.state()
        merged, new = (every if segments is None else segments), version + 1
        rest = [s for s in every if s not in merged]
        self._table(self._alive("songs", merged, every), "songs", new)
        gone = self._read("gone", merged).select("n", "below") if rest else self.spark.createDataFrame([], "n string, below long")
        if not self.searched:
            self._table(self._read("terms", merged).groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0"), "terms", new)
            self._table(gone, "gone", new)
            self._commit(new, [*rest, new])
            return new
        self._table(self._alive("exact", merged, every).select("n", "title", "variantIndex", "titleFlat", "textFlat").withColumn("row", F.monotonically_increasing_id() + new * ROWS), "exact", new)
        self._grams(new)
        self._table(self._alive("postings", merged, every), "postings", new, "term", "ref")
        terms = self._read("terms", merged).groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0")
        self._table(terms, "terms", new, "term")
        held = self._read("neighbourhoods", merged).select("key", "term")
        # terms that no segment counts any more need no way to them; with other segments left they may still
        counted = self._read("terms", merged).select("term").distinct() if rest else self._one("terms", new).select("term")
        self._table(held.join(counted, "term", "left_semi").select("key", "term").distinct(), "neighbourhoods", new, "key", "term")
        self._table(self._read("sizes", merged).agg(*[F.sum(c).alias(c) for c in ("docs", "title", "content")]), "sizes", new)
        self._table(gone, "gone", new)
        self._commit(new, [*rest, new])
        return new

    # asking

    def search(self, query: str | None, limit: int = 0, **kw) -> DataFrame:
        hits = ask.unified(search.asked_once(self.spark, query), self.indexes, limit, stem=self.stem, **kw).drop("query_id")
        return top(hits, limit, *ask.order(hits))

    def search_all(self, queries: DataFrame, limit: int = 0, **kw) -> DataFrame:
        hits = ask.unified(materialize(ask.prepared(queries), "queries"), self.indexes, limit, stem=self.stem, **kw)
        return ask.first(hits, limit) if limit > 0 else hits


def digest(*columns: str) -> Column:
    """128 bits that stand for the values of ``columns``."""
    whole = F.to_json(F.struct(*columns))
    return F.concat(F.hex(F.xxhash64(whole)), F.lit("-"), F.hex(F.xxhash64(F.reverse(whole), F.lit(1))))
