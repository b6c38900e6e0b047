"""Spelling variants against a plain comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strophe.llm import spelling
from strophe.llm.automata import Automaton

DATA = "/root/testdata/sf0.01"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=10):
    drops = {}
    for w in counts:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            drops.setdefault(x, set()).add(w)
    form, found = {}, {}
    for w, n in counts.items():
        others = {v for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for v in drops[x] if near(w, v)}
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w], found[w] = (best if best and counts[best] >= ratio * n else None), len(others)
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, found[w], counts[form[w]] if form[w] else None))
    return out


def result(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def codes(words):
    width = max(1, max(map(len, words)))
    return np.array([[ord(c) - 96 for c in w] + [0] * (width - len(w)) for w in words], np.int64).reshape(len(words), width)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "cap", "caps"})
    a = Automaton(codes(words), 28)
    assert a.size == 6  # start, after t, after c, after the vowel, after p, after s
    for number, w in enumerate(words):
        state, passed = np.array([a.start]), 0
        for c in w:
            state, more = a.step(state, np.array([ord(c) - 96]))
            passed += int(more[0])
        assert a.final[state[0]] and passed == number


@pytest.mark.parametrize("seed", range(30))
def test_automaton_against_all_pairs(seed):
    rng = random.Random(seed)
    letters = "abc"[: rng.choice([1, 2, 3])]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(seed % 3, 7))) for _ in range(rng.randint(1, 60))})
    own = codes(words)
    lengths = np.array([len(w) for w in words])
    q, n = Automaton(own, 4).near(own, lengths, lengths // 2)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and b[: len(a) // 2] == a[: len(a) // 2]}
    assert len(q) == len(want) and set(zip(q.tolist(), n.tolist(), strict=True)) == want


@pytest.mark.parametrize("group", [4, 8192])
def test_words_of_any_length(spark, group):
    """Short words, other alphabets, letters beyond the first plane; halves with more words than a group."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abж𝛼") for _ in range(rng.randint(1, 6))) for _ in range(150)}
    counts = {w: rng.choice([1, 2, 10, 20, 100, 2000]) for w in words}
    df = spark.createDataFrame([*counts.items(), (None, 5), ("zz", None)], "word string, n long")
    assert result(spelling.variants(df, group=group)) == brute(counts)


def test_ways_ties_and_repeated_rows(spark):
    rows = [("colour", 3), ("color", 40), ("colon", 40), ("colony", 40), ("colons", 500), ("colonss", 4), ("colonss", 1), ("cologne", 1)]
    counts = Counter()
    for w, n in rows:
        counts[w] += n
    got = result(spelling.variants(spark.createDataFrame([(w, n, 0) for w, n in rows], "word string, n int, form int")))
    assert got == brute(counts)
    assert ("colour", "color", "color", 3, 1, 40) in got  # then color has no form that is ten times as frequent
    assert {x[0]: x[2] for x in got}["colonss"] == "colons"


def test_long_way(spark):
    counts = {"a" * k: 10**k for k in range(1, 16)}
    got = result(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and {x[2] for x in got} == {"a" * 15}


def test_query_over_whole_table(spark):
    from strophe.llm import queries

    upper = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toLocalIterator():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert result(queries.op11_spelling_variants(spark, DATA)) == want


def test_defined_cases(spark):
    schema = "doc_id long, text string, word string, n long, run string"
    rows = [(1, None), (2, ""), (None, "Müllerei MÜLLEREI"), (3, "Abcdefg abcdefG×x 1abcdefgh"), (4, "x" * 3_000 + " " + "x" * 3_000)]
    docs = spark.createDataFrame([(*r, "w", 1, "r") for r in rows], schema)
    got = {r["word"]: r["n"] for r in spelling.counted(docs, 7, 1).collect()}
    assert got == {"müllerei": 1, "mÜllerei": 1, "abcdefg": 1, "abcdefg×x": 1, "abcdefgh": 1, "x" * 3_000: 2}
    assert spelling.counted(spark.createDataFrame([(1, "y" * 300_000)], "doc_id long, text string"), 7, 1).first()["n"] == 1
    assert result(spelling.variants(spelling.counted(docs, 7, 2))) == {("x" * 3_000, None, "x" * 3_000, 2, 0, None)}
    assert spelling.variants(spelling.counted(docs.limit(0))).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(spelling.counted(docs.limit(0))).collect() == []
