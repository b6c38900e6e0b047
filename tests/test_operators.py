"""Cases that the driver's tables do not hold: markup, labels, edits, mutations, ranking rules."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strophe.functions import markup, text
from strophe.operators import changes, lint, parse, ranking, search, store, verify
from strophe.sources import readers, writers

SONG = "#7 Night  road \n\n(а)\n1. one /two /2р.\nmore\n\nПрипев:\n{Am}la [softly]\n\n(б)\n1. other\n2. words\n\n@meta\nmeter: 8\nrhyme: ABAB\n@end\n"


def files(spark, *texts):
    return spark.createDataFrame([(f"{k:04d}.txt", t) for k, t in enumerate(texts, 1)], "file string, text string")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "clean", "flat"), [("Ночь/[тихая] (река)!", "Ночь тихая река", "ночьтихаярека"), ("а -- б", "а б", "аб"), ("{Am}слово /ещё /2р.", "{Am}слово ещё 2р", "{am}словоещё2р"), (None, "", ""), ("a\xa0b", "a b", "ab")])
def test_clean(spark, raw, clean, flat):
    assert one(spark, raw, text.clean_text) == clean and one(spark, raw, text.flatten_text) == flat


def test_clean_is_idempotent(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab /[]()!?.,;:\"'-\t\nж{}") for _ in range(30)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "x string").select(text.clean_text(F.col("x")).alias("a"))
    assert df.filter(text.clean_text(F.col("a")) != F.col("a")).count() == 0


def table_of(spark, contents, f, *more):
    """What ``f`` gives for each of the contents."""
    rows = f(spark.createDataFrame(list(enumerate(contents)), "k long, x string"), "k", "x", *more).orderBy("k").collect()
    return {contents[r["k"]]: r["html"] for r in rows}


def test_repeats(spark):
    cases = {
        "plain": "plain", "/one /2р. rest": '<span class="repeat-marker">/</span><span class="repeat">one </span><span class="repeat-marker">/2р.</span> rest', "lost /3р": "lost /3р.", "open / end": "open / end",
        "a<b & \"c\"": "a&lt;b &amp; &quot;c&quot;", "": "", None: "",
    }
    assert table_of(spark, list(cases), markup.render_repeats) == cases
    (nested,) = table_of(spark, ["//x /2р. y /3 р."], markup.render_repeats).values()
    assert nested.count("repeat-depth-1") == 1 and nested.endswith("/3р.</span>")
    tree = markup.parse_repeats(spark.createDataFrame([(1, "//x /2р. y /3р.")], "k long, x string"), "k", "x").orderBy("at").collect()
    assert [(n["depth"], n["type"], n["count"] or n["value"]) for n in tree] == [(0, "repeat", "3"), (1, "repeat", "2"), (2, "text", "x "), (1, "text", " y ")]
    assert one(spark, "/one two /2р. x", text.strip_repeats) == "one two x"


def _stack(content):
    """(depth, type, value, count) in document order, by a plain stack."""
    levels = [[]]
    for m in re.finditer(r"//|/\s*([0-9]+)\s*р\s*\.?|/|[^/]+", content):
        if m[1] and len(levels) == 1:
            levels[0].append(f"/{m[1]}р.")
        elif m[1]:
            inside = levels.pop()
            levels[-1].append((m[1], inside))
        elif m[0] in ("/", "//"):
            levels += [[] for _ in m[0]]
        else:
            levels[-1].append(m[0])
    top = levels[0] + [x for inside in levels[1:] for x in ["/", *inside]]
    out, todo = [], [(0, x) for x in reversed(top)]
    while todo:
        depth, x = todo.pop()
        if isinstance(x, str):
            out.append((depth, "text", x, None))
        else:
            out.append((depth, "repeat", None, x[0]))
            todo += [(depth + 1, y) for y in reversed(x[1])]
    return out


def test_repeat_tree_against_a_stack(spark):
    rng = random.Random(4)
    contents = ["".join(rng.choice(["/", "/", "//", "/2р.", "/3 р", "a", "b ", "<", "\n", "р."]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    deep = 100_000
    contents += ["/" * deep + "x" + "/2р." * deep, "/2р." * 5000, "/" * 5000]
    rows = markup.parse_repeats(spark.createDataFrame(list(enumerate(contents)), "k long, x string"), "k", "x").orderBy("k", "at").collect()
    got = {k: [] for k in range(len(contents))}
    for r in rows:
        assert r["at"] == len(got[r["k"]])
        got[r["k"]].append((r["depth"], r["type"], r["value"], r["count"]))
    for k, content in enumerate(contents):
        assert got[k] == _stack(content), content[:60]


def test_render_content(spark):
    (shown,) = table_of(spark, ["{Am}la {_G}[softly]\nx"], markup.render_content).values()
    assert shown == "<span class='chord chord-up'>Am</span>la <span class='chord'>G</span><span class='stage-direction'>softly</span><br/>x"
    assert table_of(spark, ["{Am}la"], markup.render_content, False) == {"{Am}la": "la"}


def test_parse_song(spark):
    song = parse.parse_songs(files(spark, SONG, "no header\n\n1. x")).collect()
    assert len(song) == 1
    s = song[0]
    assert (s["n"], s["title"], s["id"]) == (7, "Night  road", 0)
    assert [v["label"] for v in s["variants"]] == ["а", "б"]
    parts = [p for v in s["variants"] for p in v["body"]]
    assert [(p["id"], p["n"], p["type"]) for p in parts] == [(0, 1, "verse"), (1, 1, "chorus"), (2, 1, "verse"), (3, 2, "verse")]
    assert parts[0]["content"] == "one /two /2р.\nmore" and parts[1]["content"] == "{Am}la [softly]"
    assert parse.rejected(files(spark, SONG, "no header")).count() == 1


def test_headless_and_text_before_label(spark):
    s = parse.parse_songs(files(spark, "#1 T\n\nfree line\nmore\n\n(а) 1. labelled", "#2 T\n\nПрипевX la")).orderBy("n").collect()
    assert [(v["label"], [(p["type"], p["n"], p["content"]) for p in v["body"]]) for v in s[0]["variants"]] == [("", [("verse", 1, "free line\nmore")]), ("а", [("verse", 1, "labelled")])]
    assert s[1]["variants"][0]["body"][0]["type"] == "chorus"


def test_round_trip(spark):
    """Text, record, text, record: the records agree."""
    first = parse.parse_songs(files(spark, SONG, "#2 B\n\n1. a\nb\n\nПрипев:\nc\n"))
    again = parse.parse_songs(parse.song_to_text(first).select(F.format_string("%04d.txt", "n").alias("file"), "text"))
    assert sorted((r["n"], r["title"], r["variants"]) for r in again.collect()) == sorted((r["n"], r["title"], r["variants"]) for r in first.collect())


def test_meta_forms(spark):
    empty, full = "a\n@meta\n@end\nb", "a\n@meta\nx: 1\n@end\nb"
    assert one(spark, empty, text.strip_meta) == empty and one(spark, empty, text.strip_meta_lines) == "a\nb"
    assert one(spark, full, text.strip_meta) == "a\nb" and one(spark, full, text.strip_meta_lines) == "a\nb"


def test_lint(spark):
    bad = files(spark, SONG.replace("#7", "#1").replace("Night  road ", "T"), "", "#3 T\n1. a\n\n3. b\n  \n@meta\nmeter: 1\nmeter: 2\nodd\nx: 1\n\nrhyme:\n@end", "#9 T\n\ntext\n@end")
    bad = bad.unionByName(spark.createDataFrame([("a.txt", "x")], "file string, text string"))
    got = {}
    for r in lint.lint(bad).collect():
        got.setdefault(r["file"], []).append((r["line"], r["rule"][5:]))
    assert "0001.txt" not in got and got["0002.txt"] == [(0, "empty")] and got["a.txt"] == [(0, "filename")]
    want = [(0, "verse_sequence"), (2, "blank_after_header"), (5, "ws_only"), (8, "meta_duplicate"), (9, "meta_syntax"), (10, "meta_unknown_field"), (11, "meta_blank_line"), (12, "meta_empty_value")]
    assert sorted(got["0003.txt"]) == want
    assert sorted(got["0004.txt"]) == [(0, "no_parts"), (1, "number_match"), (4, "meta_unopened")]


def _found(spark, old, new):
    v = spark.createDataFrame([("0001.txt", old, new)], "file string, old_text string, new_text string")
    return sorted((r["severity"], r["check"]) for r in verify.verify(v).collect() if r["check"] != "meta_absent")


@pytest.mark.parametrize(("old", "new", "want"), [
    ("1. One two", "1. One two", []), ("1. One two", "1. one two", [("warning", "case")]), ("1. One ,two", "1. One, two", [("warning", "punctuation")]), ("1. One ,Two", "1. One, two", [("warning", "punctuation_case")]),
    ("1. One two", "1. One three", [("error", "text"), ("error", "words")]), ("1. a b\n\n2. c d", "1. a b", [("error", "part_count"), ("error", "whole_text")]),
    ("1. {A}x", "1. {B}x", [("error", "chord"), ("error", "text"), ("error", "words")]), ("1. [soft] x", "1. [loud] x", []),
])
def test_verify(spark, old, new, want):
    assert _found(spark, f"#1 T\n\n{old}", f"#1 T\n\n{new}") == want


def test_verify_suppression(spark):
    v = spark.createDataFrame([("0001.txt", "#1 T\n\n1. One {A}", "#2 T\n\n1. Two {B}")], "file string, old_text string, new_text string")
    kinds = readers.parse_suppressions(spark.createDataFrame([("1 | text",), ("# no",), ("1|chord",)], "line string"))
    judged = {(r["check"], r["suppressed"]) for r in verify.suppress(verify.verify(v), kinds).collect()}
    assert ("text", True) in judged and ("chord", False) in judged and ("header", False) in judged


SONGS = "number long, title string, variants array<struct<label:string,body:array<struct<content:string>>>>"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [
        (1, "Bright morning", [("", [("the river sings softly",)])]), (2, "River song", [("а", [("evening light",)]), ("б", [("harvest moonlight",)])]),
        (3, "Quiet hills", [("", [("bright stars over water",), ("second verse line",)])]), (4, "Evening", None),
    ]
    return search.SearchSession(spark.createDataFrame(rows, SONGS), str(tmp_path_factory.mktemp("index")))


def test_search(spark, index):
    numbers = lambda q, k=0: [r["n"] for r in index.search(q, k).collect()]
    assert numbers("ri") == [] and numbers("  ") == [] and numbers(None) == []
    assert numbers("bright")[0] == "1" and set(numbers("bright")) >= {"1", "3"}
    assert numbers("rivr")[:2] and set(numbers("rivr")) >= {"1", "2"}
    hit = index.search("harvest").first()
    assert (hit["n"], hit["variantIndex"], hit["matchType"]) == ("2", 1, "exact")
    assert numbers("brightmorn") == ["1"] and numbers("songevening") == ["2"]
    whole = numbers("river")
    assert whole[:2] == ["2", "1"] and numbers("river", 1) == ["2"] and numbers("river", -1) == whole
    rows = index.search("river").collect()
    tiers = [r["tier"] for r in rows]
    assert tiers == sorted(tiers) and len({r["n"] for r in rows}) == len(rows)
    exact = search.search_exact(index.exact, "river").collect()
    assert {r["n"] for r in exact} <= {r["n"] for r in rows} and exact[0]["score"] > 2 >= exact[1]["score"]


def test_lexical_rules(index):
    run = lambda q: [r["n"] for r in search.search_lexical(index.index, index.stats, q).collect()]
    assert run("second bright") == ["3"]  # the first word is required
    assert set(run("absent bright")) >= {"1", "3"}  # none has it: any word
    assert run("bright")[0] == "1"  # the title counts more
    assert set(run("brigth")) >= {"1", "3"}


@given(st.text(alphabet="абвгдежиклмностуыьюяйщ", max_size=14))
@settings(max_examples=200, deadline=None)
def test_stemmer_only_shortens(word):
    stem = search.stem_word(word)
    assert word.startswith(stem[:-1]) and len(stem) <= len(word)


def test_store(spark):
    c = spark.createDataFrame([(1, "a", None), (2, "f", 1), (3, "f2", 1)], "id long, name string, isFavorite int").withColumn("createdAt", F.current_timestamp()).withColumn("updatedAt", F.current_timestamp())
    links = spark.createDataFrame([(1, 1, 10, None), (2, 1, 11, 0), (3, 2, 11, 1), (4, 1, 99, 0)], "id long, collectionId long, songNumber long, variantIndex int")
    songs = spark.createDataFrame([(10, "x"), (11, "y")], "number long, title string")
    assert [(r["number"], r["variantIndex"]) for r in store.songs_in_collection(links, songs, 1).collect()] == [(10, 0), (11, 0)]
    assert [r["id"] for r in store.available_collections(links, c, 10).orderBy("id").collect()] == [2, 3]
    assert store.favorite_id(c).first()["collectionId"] == 2
    assert store.favorite_add(links, c, 10).filter("collectionId = 2").count() == 2
    with pytest.raises(store.DuplicateError):
        store.favorite_add(links, c, 11, 1)
    with pytest.raises(store.AbsentError):
        store.remove_link(links, 1, 10, 0)  # a missing index never matches
    assert store.favorite_toggle(links, c, 11, 1).count() == 3
    left, rest = store.delete_collection(c, links, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 2 and rest.count() == 1
    none = c.withColumn("isFavorite", F.lit(None).cast("int"))
    assert store.ensure_favorite(none, "f", F.current_timestamp()).count() == 4 and store.ensure_favorite(c, "f", F.current_timestamp()).count() == 3
    with pytest.raises(store.AbsentError):
        store.favorite_add(links, none, 10)


def test_changes(spark):
    rows = [("a", "b", 200, False), ("a", "a", 200, False), ("", "b", 200, False), ("a", None, 200, False), ("a", "b", 404, False), ("a", "b", None, True)]
    got = changes.etag_changed(spark.createDataFrame(rows, "stored string, new string, status int, failed boolean")).collect()
    assert [(r["changed"], r["new_etag"]) for r in got] == [(True, "b"), (False, "a"), (False, "b"), (False, ""), (False, "a"), (False, "a")]


def test_ordinals(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abж") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "w string, k long").repartition(5)
    got = [r["k"] for r in ranking.with_ordinal(df, "at", F.col("w"), F.col("k")).orderBy("at").collect()]
    assert got == [k for _, k in sorted((w.encode(), k) for k, w in enumerate(words))]
    assert ranking.with_ordinal(df.limit(0), "at", F.col("w")).count() == 0
    down = [r["k"] for r in ranking.with_ordinal(df, "at", F.desc("w"), F.col("k"), first=7).orderBy("at").collect()]
    order = sorted(range(500), key=lambda k: k)
    order.sort(key=lambda k: words[k].encode(), reverse=True)
    assert down == order


@pytest.mark.parametrize("key", ["concat('a common prefix of names ', id)", "'one name'"])
def test_ordinals_of_one_prefix_and_of_one_name(spark, key):
    """Neither puts most rows into one range."""
    df = spark.range(20_000).select(F.expr(key).alias("w"), "id")
    got = ranking.with_ordinal(df, "at", F.col("w"))
    assert got.agg(F.min("at"), F.max("at"), F.countDistinct("at")).first() == (0, 19_999, 20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges are as many as the data needs
    try:
        sizes = [r["n"] for r in ranking.ranged(df.repartition(3), F.col("w")).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 8_000


def test_deep_marks():
    deep = 100_000
    nested = "/" * 1 + " / " * (deep - 1) + "x" + " /2р." * deep
    nodes = markup.tree(nested)
    flat = list(markup.walk(nodes))
    assert max(d for d, _, _ in flat) == deep and markup.html(nodes).count("<span class=\"repeat") == 3 * deep
    assert markup.html(markup.tree("/ " * deep)).count("/") == deep


def test_exact_index_of_a_repeated_number(spark):
    rows = [(1, "one", [("", [("a",)])]), (1, "uno", [("", [("b",)])])]
    songs = spark.createDataFrame(rows, "number long, title string, variants array<struct<label:string,body:array<struct<content:string>>>>")
    assert sorted((r["title"], r["textFlat"]) for r in search.exact_index(songs).collect()) == [("one", "onea"), ("uno", "unob")]


def test_stop_words_and_transpositions(spark, tmp_path):
    rows = [(1, "alpha", [("", [("the river runs",)])]), (2, "beta", [("", [("the hills",)])])]
    songs = spark.createDataFrame(rows, "number long, title string, variants array<struct<label:string,body:array<struct<content:string>>>>")
    own = search.SearchSession(songs, str(tmp_path / "i"), stopwords=("the",))
    assert own.search_lexical("the", fuzzy=0).count() == 0 and [r["n"] for r in own.search_lexical("river", fuzzy=0).collect()] == ["1"]
    assert own.search_lexical("rievr", fuzzy=1).count() == 0
    assert [r["n"] for r in own.search_lexical("rievr", fuzzy=1, transposed=True).collect()] == ["1"]
    far = search.lexical_hits(own.index, own.stats, "river", fuzzy=0)
    assert [r["n"] for r in far.collect()] == ["1"]


def test_sinks_and_sources(spark, tmp_path):
    songs = parse.parse_songs(files(spark, SONG, "#2 B\n\n1. a"))
    writers.song_files(songs, str(tmp_path / "txt"))
    back = {r["file"]: r["text"] for r in readers.text_dir(spark, str(tmp_path / "txt")).collect()}
    assert set(back) == {"0007.txt", "0002.txt"} and back["0002.txt"] == "#2 B\n\n1. a\n"
    (tmp_path / "b.json").write_text('{"songs": [{"id": 0, "n": 3, "title": "t", "variants": []}], "sections": []}')
    assert readers.json_bundle(spark, str(tmp_path / "b.json")).first()["n"] == 3
    (tmp_path / "bad.json").write_text('{"songs": [')
    with pytest.raises(Exception):  # noqa: B017
        readers.json_bundle(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "names.tsv").write_text("1\tone\n\n 2\t two \n1\tuno\nx\ty\n")
    assert {(r["n"], r["name"]) for r in readers.tsv_names(spark, str(tmp_path / "names.tsv")).collect()} == {(1, "uno"), (2, "two")}


def test_arrivals(spark, tmp_path):
    from strophe.streaming import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0001.txt").write_text("#1 T\n\n1. a\n")
    (tmp_path / "in" / "x.txt").write_text("x")
    arrivals.ingest(arrivals.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/headers")).count() == 2
    assert [r["rule"] for r in spark.read.parquet(str(tmp_path / "out/violations")).collect()] == ["lint_filename"]


def test_rules_and_checks_alone(spark):
    """Asked for one by one they give the rows of all together, and only what they need is planned."""
    texts = files(spark, SONG, "no header\n\n1. x\n3. y\n  \n(а)\nz\n@meta\nmeter:\nfoo: 1\n@end", "", "#4 t\n1. a\n@end\n@meta")
    row = lambda r: (r["file"], r["line"], r["rule"], r["message"])
    every = sorted(map(row, lint.lint(texts).collect()))
    assert sorted(x for rule in lint.MESSAGES for x in map(row, lint.lint(texts, (rule,)).collect())) == every
    assert sorted(map(row, lint.lint(texts, ("lint_ws_only", "lint_header")).collect())) == [x for x in every if x[2] in ("lint_ws_only", "lint_header")]
    assert lint.lint(texts, ()).collect() == []
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(lint.lint(texts)) and "Window" not in plan(lint.lint(texts, ("lint_ws_only",)))
    v = spark.createDataFrame([("0001.txt", "#1 T\n\n1. One /{A} b /2р.", "#2 T\n\n1. Two {B}")], "file string, old_text string, new_text string")
    found = lambda df: sorted((r["check"], r["message"]) for r in df.collect())
    whole = found(verify.verify(v))
    assert sorted(x for c in (*verify.TEXT_CHECKS, *verify.REPEAT_CHECKS, *verify.ROW_CHECKS) for x in found(verify.verify(v, (c,)))) == whole and len(whole) > 4
    assert "Window" not in plan(verify.verify(v, ("header",)))
    with pytest.raises(ValueError, match="no such"):
        lint.lint(texts, ("lint_x",))
