"""Few queries read the texts once and write no index; their hits are those of the plain forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strophe.functions.text import clean_text, lowered
from strophe.operators import edits, scan, search
from strophe.plans import search_queries

DATA = "/root/testdata/sf0.001"
SONGS = "number long, title string, variants array<struct<label:string,body:array<struct<content:string>>>>"
WORDS = ["the", "then", "Thean", "tehan", "river", "rivers", "ΟΔΟΣ", "ΑΣ.Α", "Ärger", "a b", "x\x1cy", "​", "ﬁn", "İx", "-", "(old)", "gold", "\n", "моро", "𛀀"]


def made(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: rng.choice((" ", ", ", "\t")).join(rng.choice(WORDS) for _ in range(n))
    body = lambda: None if rng.random() < 0.1 else [(None if rng.random() < 0.1 else text(rng.randint(0, 9)),) for _ in range(rng.randint(0, 3))]
    rows = [(k, None if k % 11 == 0 else text(rng.randint(0, 3)), None if k % 9 == 0 else [("", body()) for _ in range(rng.randint(0, 3))]) for k in range(80)]
    songs = spark.createDataFrame(rows, SONGS)
    return songs, search.SearchSession(songs, str(tmp_path / "session"))


def hits(df):
    return sorted((r["n"], r["variantIndex"], round(r["score"], 6), r["title"], r["matchType"]) for r in df.collect())


def test_one_search_writes_no_index(spark, tmp_path):
    songs, own = made(spark, tmp_path)
    index, exact = search.postings(songs).cache(), search.exact_index(songs).cache()
    stats = search.statistics(search.prepare_variants(songs)).cache()
    for query in ("The, rivr", "zzz thean", "одос", "x y", "ab", None):
        assert hits(own.search(query)) == hits(search.search_unified(exact, index, stats, query)), query
    assert hits(own.search_exact("ΑΣ α")) == hits(search.search_exact(exact, "ΑΣ α"))
    assert hits(own.search_lexical("old gold")) == hits(search.search_lexical(index, stats, "old gold"))
    assert hits(own.search_lexical("tehan", transposed=True, fuzzy=1)) == hits(search.search_lexical(index, stats, "tehan", transposed=True, fuzzy=1))
    assert not os.path.exists(own.path)


def test_filled_limit(spark, tmp_path):
    songs, own = made(spark, tmp_path)
    every = [(r["tier"], r["score"]) for r in own.search("the").collect()]
    assert len(every) > 3 and every[2][0] == 0
    assert [(r["tier"], r["score"]) for r in own.search("the", 3).collect()] == every[:3]
    assert not os.path.exists(own.path)


def test_table_of_queries_as_indexed(spark, tmp_path):
    songs, own = made(spark, tmp_path)
    queries = [f"{a} {b}".strip() for a in ("the", "gold", "zzzz", "yyyy", "river gold", "zzzz the", "") for b in ("thean", "rivers", "old", "моро")]
    asked = spark.createDataFrame([(k, q) for k, q in enumerate([*queries, "x", None])] + [(None, "the")], "query_id long, query string")
    row = lambda df, *more: sorted((r["query_id"], r["n"], r["variantIndex"], round(r["score"], 6), r["title"], r["tier"], *(r[c] for c in more)) for r in df.collect())
    got, first = row(own.search_all(asked)), row(own.search_all(asked, 3), "rank")
    assert not os.path.exists(own.path)
    assert own.indexes and own.exact_indexes  # written: asked from now on
    assert got == row(own.search_all(asked)) and first == row(own.search_all(asked, 3), "rank")
    assert {r[0] for r in got} >= set(range(4))


def test_same_words_share_their_scores(spark, tmp_path, monkeypatch):
    """Scores of 40 queries with the same last word and unknown other ones are worked out once."""
    songs, own = made(spark, tmp_path)
    asked = spark.createDataFrame([(k, f"zz{k}zz thean") for k in range(40)], "query_id int, query string")
    written = {}
    keep = lambda df, name, *a: written.setdefault(name, whole(df, name, *a))
    whole = scan.materialize
    monkeypatch.setattr(scan, "materialize", keep)
    out = own.search_all(asked).collect()
    assert len({r["query_id"] for r in out}) == 40
    assert written["matched-terms"].count() == written["answering-terms"].count()


def test_near_words_against_distance(spark):
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abж𝛼") for _ in range(rng.randint(1, 9))) for _ in range(600)})
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string").cache()
    for word in ("ab", "abж", "a𝛼bж", "ababab", "x", "жжжжжжжж"):
        for fuzzy in (0, 1, 2, 3):
            for transposed in (False, True):
                want = {r["term"] for r in vocabulary.filter(edits.within(F.col("term"), F.lit(word), fuzzy, transposed)).collect()}
                assert scan.near(set(terms) | {""}, [word], fuzzy, transposed) == want


def test_words_as_cleaned(spark):
    """Lower case first and marks after it leave what cleaning first leaves, white space of all kinds included."""
    odd = [f"a{chr(c)}B" for c in (*range(1, 0x250), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)] + ["ΑΣ.Α ΑΣ", "Σ'Σ", "ΣΑ-Σ", " ..a  b..", "", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, x string").select("k", lowered(F.col("x")).alias("low"), F.lower(clean_text(F.col("x"))).alias("want")).orderBy("k")
    rows = df.collect()
    assert [*scan._plain([r["low"] for r in rows])] == [r["want"] for r in rows]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["search_unified", "search_all", "search_all_top", "except_exact", "lexical_not_in_exact", "search_fuzzy", "search_lexical", "ui_limit"])
def test_registered_search_writes_no_index(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(search_queries, "_sessions", {})
    monkeypatch.setattr(search_queries, "fresh_folder", lambda *_: str(tmp_path / "indexes"))
    assert search_queries.QUERIES[name](spark, DATA).limit(1).count() == 1
    assert not os.path.exists(tmp_path / "indexes")
