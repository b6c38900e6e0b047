"""Set-at-a-time search, substring and fuzzy indexes, and indexes that follow updates, against plain forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strophe.operators import ask, edits, grams, search
from strophe.operators.segments import LiveIndex

SONGS = "number long, title string, variants array<struct<label:string,body:array<struct<content:string>>>>"
WORDS = [a + b for a in ("the", "river", "song", "ри", "bright", "st", "моро", "ou") for b in ("", "s", "ing", "е", "ght", "ar", "з")]


def songs_of(rng, numbers):
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return [(k, text(rng.randint(0, 3)), None if k % 9 == 0 else [("", [(text(rng.randint(0, 12)),)]) for _ in range(rng.randint(0, 3))]) for k in numbers]


def hits(df):
    return {(r["query_id"], r["n"], r["variantIndex"], round(r["score"], 6), r["title"], r["matchType"], r["tier"]) for r in df.collect()}


def plain(index, spark, query):
    """Hits of one query by scans of the unwritten indexes."""
    df = search.search_unified(index[0], index[1], index[2], query)
    return {(query, r["n"], r["variantIndex"], round(r["score"], 6), r["title"], r["matchType"], r["tier"]) for r in df.collect()}


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    rng = random.Random(7)
    songs = spark.createDataFrame(songs_of(rng, range(60)), SONGS)
    return search.SearchSession(songs, str(tmp_path_factory.mktemp("session")))


def test_thousand_queries_at_once(spark, own):
    rng = random.Random(3)
    queries = {" ".join(rng.choice(WORDS)[: rng.randint(2, 7)] for _ in range(rng.randint(1, 3))) for _ in range(1600)}
    queries = sorted(queries)[:1000]
    assert len(queries) == 1000
    got = hits(own.search_all(spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")))
    texts = [(r["n"], r["variantIndex"], r["titleFlat"], r["textFlat"]) for r in own.exact.collect()]
    for q in queries:
        needle = q.lower().replace(" ", "")
        want = {n for n, _, _, t in texts if needle in t} if len(q) >= 3 else set()
        assert {h[1] for h in got if h[0] == q and h[6] == 0} == want
    scanned = (own.exact.drop("row"), own.index, own.stats)
    for q in rng.sample(queries, 4) + ["st"]:
        assert {h for h in got if h[0] == q} == plain(scanned, spark, q)


def test_limit_of_each_query(spark, own):
    asked = spark.createDataFrame([("a", "the"), ("b", "rivr songs"), ("c", None), ("d", " x "), (None, "the")], "query_id string, query string")
    every, few = own.search_all(asked).collect(), own.search_all(asked, 3).collect()
    assert {r["query_id"] for r in every} == {"a", "b"}
    for q in "ab":
        tiers = sorted((r["tier"], -round(r["score"], 6)) for r in every if r["query_id"] == q)[:3]
        assert sorted((r["tier"], -round(r["score"], 6)) for r in few if r["query_id"] == q) == tiers
        assert sorted(r["rank"] for r in few if r["query_id"] == q) == list(range(1, len(tiers) + 1))
    # a filled limit needs no postings
    ix = own.exact_indexes
    filled = ask.unified(ask.prepared(asked.filter("query_id = 'a'")), ix, 3)
    assert filled.count() >= 3


@pytest.mark.parametrize("block", [3, 8192])
def test_substring_index_against_scan(spark, monkeypatch, block):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abж𝛼") for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["", "ab" * 2000, "𝛼"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row long, text string").coalesce(1)
    if block != 8192:
        monkeypatch.setattr(grams, "BLOCK_ROWS", block)
    index = grams.postings(rows).cache()
    needles = sorted({t[a : a + n] for t in texts for a in (0, 3) for n in (2, 3, 4, 9) if len(t[a : a + n]) == n} | {"zz", "zzz", "abzzab"})[:200]
    picks = grams.picked(spark.createDataFrame([(x,) for x in needles], "needle string"), grams.counts(index))
    met = {(r["needle"], r["row"]) for r in grams.candidates(index, picks).collect()}
    for x in needles:
        holding = {k for k, t in enumerate(texts) if x in t}
        found = {k for n, k in met if n == x}
        assert holding <= found
        if len(x) <= 3:
            assert holding == found
    assert {n for n, _ in met} <= {x for x in needles if "zz" not in x}


def test_scans_are_filtered(own):
    """A search of few grams and terms asks the files for these alone."""
    plan = own.grams.filter(F.col("gram").isin("the", "riv"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan


@pytest.mark.parametrize("transposed", [False, True])
def test_fuzzy_index_against_scan(spark, transposed):
    rng = random.Random(11)
    terms = {"".join(rng.choice("abcж") for _ in range(rng.randint(1, 14))) for _ in range(900)} | {"x" * 40, "x" * 41, "x" * 43, "interesting", "intersting", "itneresting"}
    vocabulary = spark.createDataFrame([(t, 1) for t in terms], "term string, df long").cache()
    words = spark.createDataFrame([(w,) for w in [*rng.sample(sorted(terms), 40), "", "q", "x" * 42, "interesting"]], "word string")
    index = edits.neighbourhoods(vocabulary)
    for most in (0, 1, 2):
        got = {(r["word"], r["term"]) for r in edits.near_terms(index, edits.keys_of(words, most, transposed), most, transposed).collect()}
        want = {(r["word"], r["term"]) for r in words.join(vocabulary, edits.within(F.col("term"), F.col("word"), most, transposed)).collect()}
        assert got == want


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_updates_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(9)
    songs = {s[0]: s for s in songs_of(rng, range(40))}
    df = lambda rows: spark.createDataFrame(list(rows), SONGS)
    live = LiveIndex.create(df(songs.values()), str(tmp_path / "live"))
    asked = spark.createDataFrame([(q, q) for q in ("the", "rivr", "songs bright", "ouar", "морз")], "query_id string, query string")

    def same():
        rebuilt = LiveIndex.create(df(songs.values()), str(tmp_path / f"new-{rng.random()}"))
        assert hits(live.search_all(asked)) == hits(rebuilt.search_all(asked))
        counts = lambda x: {(r["term"], r["df"]) for r in x.indexes.vocabulary.collect()}
        assert counts(live) == counts(rebuilt)
        assert {r["number"] for r in live.songs().collect()} == set(songs)

    changed = {s[0]: s for s in songs_of(rng, [3, 5, 50])}
    songs = {k: v for k, v in (songs | changed).items() if k not in (7, 8)}
    assert live.sync(df(songs.values())) == 1 and live.sync(df(songs.values())) == 1  # nothing to do
    same()
    back = {s[0]: s for s in songs_of(rng, [3, 7])}
    songs |= back
    del songs[5]
    live.update(df(back.values()), spark.createDataFrame([(5,), (999,)], "number long"))
    live.compact([1, 2])
    songs |= {s[0]: s for s in songs_of(rng, [8, 50])}
    live.sync(df(songs.values()))
    same()
    live.compact()
    assert live.state()[1] == [5]
    same()


def test_an_update_writes_its_share(spark, tmp_path):
    rng = random.Random(2)
    rows = songs_of(rng, range(3000))
    live = LiveIndex.create(spark.createDataFrame(rows, SONGS).coalesce(1), str(tmp_path / "live"))
    before = _size(tmp_path / "live" / "postings") + _size(tmp_path / "live" / "exact")
    live.update(spark.createDataFrame(songs_of(rng, range(0, 3000, 100)), SONGS).coalesce(1))
    more = _size(tmp_path / "live" / "postings") + _size(tmp_path / "live" / "exact") - before
    assert more < before / 4  # a hundredth of the rows, and the files' own descriptions
