"""Nearest neighbours, SimHash groups and components against brute force."""

import random
import time

import numpy as np
import pandas as pd
import pytest
import xxhash

from strophe.llm import ann, graph, simhash

DATA = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>"


def neighbours(rows, queries, k):
    """{query: [(vec_id, score)]} in double precision."""
    out = {}
    for q, y in queries:
        scored = sorted(((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, x in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in rows.select("vec_id", "embedding").collect()]
    got = ann.search(rows, rows.filter("vec_id % 20 = 0"), k=20, shard_rows=200, block_rows=16).toPandas()
    want = neighbours(data, [d for d in data if d[0] % 20 == 0], 20)
    by = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    assert set(by) == set(want)
    hits = 0
    vec = dict(data)
    for q, g in by.items():
        assert g["rank"].tolist() == list(range(1, 21))
        assert list(zip(-g["score"], g["vec_id"], strict=True)) == sorted(zip(-g["score"], g["vec_id"], strict=True))
        for v, s in zip(g["vec_id"], g["score"], strict=True):
            assert abs(s - float(np.dot(np.array(vec[v], float), np.array(vec[q], float)))) < 1e-9
        hits += len(set(g["vec_id"]) & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], VECTORS + ", rank int, query_id int")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -1.0)]
    assert ann.search(df.limit(0), df, k=5).count() == 0
    assert ann.search(df, df.limit(0), k=5).count() == 0


def test_ann_repeated_rows(spark):
    """Ids that repeat, as queries and as candidates, give twenty different neighbours with the best scores."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(400)]
    many = rows + [rows[20]] * 2 + [rows[33]] * 150 + [(44, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(many, VECTORS).repartition(5)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=20, shard_rows=150, block_rows=8, share=1.0).toPandas()
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        own = np.array([v for i, v in many if i == q], np.float32).astype(float)
        best = {}
        for i, v in many:
            if i != q:
                best[i] = max(best.get(i, -np.inf), (own @ np.array(v, np.float32).astype(float)).max())
        want = sorted((-s, i) for i, s in best.items())[:20]
        assert g["rank"].tolist() == list(range(1, 21)) and g["vec_id"].tolist() == [i for _, i in want]
    assert got["query_id"].nunique() == 20


def fingerprint(text, words):
    parts = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps, ids, distance):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "x\xa0y", "Ab"]
    out = ["", None, " \t\n", "One", "ONE", "a b c d", "A  B\tc d"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
    return out


def test_simhash_is_brute_force(spark):
    every = texts(7)
    ids = list(range(10, 10 + len(every)))
    got = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, every, strict=True)), "doc_id long, text string")).toPandas().set_index("doc_id")
    fps = [fingerprint(t, 4) for t in every]
    want = closure(fps, ids, 4)
    assert [int(x, 16) for x in got.loc[ids, "fingerprint"]] == fps
    assert got["component_id"].to_dict() == want
    assert (got["fingerprint"].str.len() == 16).all()


@pytest.mark.parametrize(("hot", "count"), [(4096, 1), (2, 1), (4096, 1 << 40), (3, 1 << 30)])
def test_links_lose_no_pair(spark, hot, count):
    rng = random.Random(hot + count % 7)
    centres = [rng.getrandbits(64) for _ in range(5)]
    fps = set(centres)
    for c in centres:
        for _ in range(25):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    edges = simhash.links(df, count, 4, hot=hot)
    for e in edges.collect():
        assert e["u"] < e["v"]
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    want = closure(fps, list(range(len(fps))), 4)
    assert {i: roots.get(i, i) for i in want} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    root = {}
    for u, v in edges:
        a, b = u, v
        while root.get(a, a) != a:
            a = root[a]
        while root.get(b, b) != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    nodes = {x for e in edges for x in e}
    assert {n: got.get(n, n) for n in nodes} == {n: find(n) for n in nodes}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edges(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    rows = [(5, "a b c d e f", "x", 1), (3, "a b c d e f", None, 2), (3, "other words stand here now", "y", 3), (None, "a b c d e f", "z", 4), (3, "a b c d e f", None, 2), (9, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = simhash.near_duplicates(df).select("doc_id", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(5, 3), (3, 3), (3, 3), (3, 3), (9, 9), (None, None)], key=str)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == [-1, 3, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{k % 997}" for k in range(300_000))
    got = simhash.near_duplicates(spark.createDataFrame(pd.DataFrame({"doc_id": [1], "text": [text]}))).first()
    assert int(got["fingerprint"], 16) == simhash.fingerprint(text, 4) % (1 << 64)


def plain_cell(ids, vectors, query_ids, queries, longest, k, projections, threshold, share, growth, seed):
    """``ann.search_cell`` by lists of what enters each window, all candidates put in order."""
    n, dim = vectors.shape
    axes = np.random.default_rng(seed).standard_normal((dim + 1, projections))
    data = (np.c_[vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))] @ axes).T
    order = np.argsort(data, axis=1, kind="stable")
    arrays, out = np.take_along_axis(data, order, axis=1), []
    for q, (name, y) in enumerate(zip(query_ids, queries, strict=True)):
        norm, counts, done = np.linalg.norm(y), np.zeros(n, np.int64), np.zeros(n, bool)
        centre, radius = (y / norm * longest) @ axes[:-1], max(float(arrays.std()), 1e-9) * 0.8
        scores = np.einsum("ij,j->i", vectors, y)
        while True:
            ends = [(np.searchsorted(a, c - radius, "left"), np.searchsorted(a, c + radius, "right")) for a, c in zip(arrays, centre, strict=True)]
            counts = np.bincount(np.concatenate([o[a:z] for o, (a, z) in zip(order, ends, strict=True)]), minlength=n)
            done |= (counts >= np.ceil(threshold * projections)) & (ids != name)
            if done.sum() >= min(share * n + 5 * k, n - (ids == name).sum()):
                break
            worst = np.sort(scores[done])[-k] if done.sum() >= k else None
            if worst is not None and np.sqrt(max(0.0, 2 - 2 * worst / (norm * longest))) * longest <= radius / growth:
                break
            radius *= growth
        at = np.flatnonzero(done)
        out += [(q, int(v), float(scores[v])) for v in at[np.lexsort((ids[at], -scores[at]))][:k]]
    return out


def test_cell_counts_in_windows():
    """The same neighbours as the plain walk, ties included, in clearly less time."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x[1500:1800] = x[:300]  # ties
    ids, queries = rng.permutation(3000) * 3, x[::10]
    args = (ids, x, ids[::10], queries, float(np.linalg.norm(x, axis=1).max()), 20, 64, 0.65, 0.15, 1.35, 11)

    def timed(f):
        began = time.process_time()
        return f(*args), time.process_time() - began

    want, plain = min((timed(plain_cell) for _ in range(3)), key=lambda r: r[1])
    got, own = min((timed(ann.search_cell) for _ in range(3)), key=lambda r: r[1])
    q, v, s = got
    assert [(a, b) for a, b, _ in want] == list(zip(q.tolist(), v.tolist(), strict=True)) and np.allclose(s, [c for _, _, c in want])
    assert own < 0.4 * plain
