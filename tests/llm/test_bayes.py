"""Bayesian verification: posterior bounds, and components against all pairs."""

import random

import numpy as np
import pytest

from strophe.llm import bayes

SCHEMA = "doc_id long, text string"


def runs(text, words):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, words=2):
    """{(doc_id, set size, component, kept)}; rows with a doc_id, one each."""
    sets = {i: runs(t, words) for i, t in rows}
    root, ids = {i: i for i in sets}, sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if root[i] != root[j] and a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {(i, len(sets[i]), root[i], root[i] == i) for i in sets}


def result(df):
    return {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("n", [32, 96, 128])
def test_posterior_bound(n):
    """The mass of the posterior above the bound, by numeric integration."""
    t, s = 0.8, (np.arange(200_000) + 0.5) / 200_000
    need = bayes.least_matches(n, t, 1e-4)
    for m, enough in ((need, True), (need - 1, False)):
        density = np.exp(m * np.log(s) + (n - m) * np.log1p(-s))
        assert (density[s >= t].sum() / density.sum() >= 1e-4) == enough


def test_pairs_beyond_the_bound_are_dropped():
    rng = np.random.default_rng(1)
    needs = bayes.bounds(128, 0.8, 1e-5)
    a = rng.integers(0, 2**16, (3000, 128), dtype=np.uint16)
    for similarity, most, least in ((0.85, 3000, 2995), (0.5, 40, 0), (0.1, 0, 0)):
        b = np.where(rng.random(a.shape) < similarity, a, a ^ np.uint16(1))
        assert least <= len(bayes.survives(a, b, needs)) <= most


def _planted(rng):
    """A group of copies with one to many changed words, a chain, texts that share a long passage."""
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for k in range(90):
        copy = list(base)
        for _ in range(k % 16):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    out += [" ".join(words[k : k + 100]) for k in range(0, 120, 5)]
    passage = " ".join(rng.choice(words) for _ in range(50))
    return out + [passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(10 + k % 20)) for k in range(60)]


@pytest.mark.parametrize("chunk", [7, 512])
def test_components_against_all_pairs(spark, monkeypatch, chunk):
    """Buckets that fall into several components, in one chunk and in many."""
    monkeypatch.setattr(bayes, "CHUNK", chunk)
    rows = list(enumerate(_planted(random.Random(4)), 10))
    rng = random.Random(8)
    rng.shuffle(rows)
    rows += [(1000 + k, rows[3][1]) for k in range(40)]
    assert result(bayes.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2)) == brute(rows)


def test_verified_links_of_one_task():
    """No member is near the largest component; pairs of members outside of it are told once."""
    import pandas as pd

    sets = [list(range(50)), list(range(100, 150)), list(range(102, 152)), list(range(106, 156)), list(range(300, 350))]
    some = np.random.default_rng(2).integers(0, 9, 128).astype("<u2").tobytes()
    rows = [(0, i, 50, i, i > 0, some, sets[i]) for i in range(1, 5)] + [(1, i, 50, i, i > 0, some, sets[i]) for i in range(5)]
    b = pd.DataFrame(rows, columns=["side", "own", "n", "root", "minor", "signature", "runs"])
    got = bayes._verified(bayes.bounds(128, 0.8, 1e-5), 80)(b)
    assert set(map(tuple, got.to_numpy().tolist())) == {(1, 2), (2, 3)}
    assert len(bayes._surviving(bayes.bounds(128, 0.8, 1e-5), 80)(b)) == 8


def test_other_shingles_and_deduplicate(spark):
    rows = list(enumerate(_planted(random.Random(6))))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5)
    assert result(bayes.near_duplicates(docs)) == want
    assert {r["doc_id"] for r in bayes.deduplicate(docs).collect()} == {i for i, _, _, kept in want if kept}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "ÀB c"), (8, "àb c"), (9, "a b c d e"), (None, "a b c d e"), (None, None), (12, "a b c d e"), (12, "p q r s"), (13, "p q r s"), (14, "z " * 300_000)]
    named = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], SCHEMA + ", own long, node long, key string, _node long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in bayes.near_duplicates(named, words=2).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 4, 9, True)]
    want += [(None, 4, None, True), (None, 0, None, True), (12, 4, 9, False), (12, 3, 9, False), (13, 3, 9, False), (14, 1, 14, True)]
    assert got == sorted(want, key=str)
    empty = bayes.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.collect() == []
