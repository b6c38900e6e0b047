"""Near copies of the pipeline stage against all pairs, and a group in which no member is near all others."""

import random

import corpus_pipeline
from strophe.llm import near, simhash

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def runs(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])


def similar(a, b):
    return len(a & b) * 10 >= len(a | b) * 8


def brute(rows):
    """doc_id -> smallest doc_id over links of similarity 0.8 or more, by all pairs."""
    sets = {i: runs(t) for i, t in rows}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if root[i] != root[j] and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and similar(a, b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_stage_finds_pairs_of_similarity_08(spark):
    """Pairs of five-word similarity 0.8 or more, however many fingerprint bits differ, are one component."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    root = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert kept == set(root.values())


def test_chain_is_one_component(spark):
    """Each text is near the next only; copies of one text and other texts lie between them."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    chain = [" ".join(words[k : k + 100]) for k in range(0, 120, 4)]
    rows = list(enumerate(chain + [chain[7]] * 5 + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)] + ["", "a b", "a b"]))
    got = near.near_copies(spark.createDataFrame([*rows, (None, "a b"), (99, None)], SCHEMA))
    root = brute([*rows, (99, "")])
    assert len(set(root.values())) == 23
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == root


def test_bucket_with_several_components():
    """A bucket whose members are not near its smallest one still gives their links."""
    import pandas as pd

    sets = [list(range(0, 50)), list(range(100, 150)), list(range(102, 152)), list(range(104, 154)), list(range(300, 350))]
    b = pd.DataFrame({"key": 1, "own": range(5), "root": range(5), "chunk": 0, "runs": sets})
    out = near._bucket_links(0.8)(b)
    assert {tuple(r) for r in out.to_numpy().tolist()} in ({(1, 2), (2, 3)}, {(1, 2), (1, 3)})


def test_chunks_of_a_large_bucket(spark, monkeypatch):
    """A bucket over several chunks gives the components of one."""
    monkeypatch.setattr(near, "CHUNK", 7)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(words[k % 30 : k % 30 + 60 + rng.randint(0, 4)])) for k in range(90)]
    got = near.near_copies(spark.createDataFrame(rows, SCHEMA), bands=40, rows=1)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute(rows)


def test_simhash_names_candidates(spark):
    """Without any key in common, texts within 4 bits are candidates; the exact check still decides."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(600)]
    lines = [" ".join(base), " ".join(base[:-3] + ["other"] * 3), " ".join(rng.choice(words) for _ in range(600))]
    # the run that repeats gives both the same fingerprint, and their sets have that run alone in common
    same = ["b " * 500 + " ".join(rng.choice(words) for _ in range(20)) for _ in range(2)]
    rows = list(enumerate(lines + same))
    fps = [simhash.majority(near.every_run(t, 5)) for _, t in rows]
    assert fps[0] != fps[1] and ((fps[0] ^ fps[1]) % 2**64).bit_count() <= 4 and fps[3] == fps[4]
    got = near.near_copies(spark.createDataFrame(rows, SCHEMA), bands=1, rows=1000)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute(rows) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
