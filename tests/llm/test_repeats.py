"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from strophe.llm import repeats
from strophe.llm.suffixes import repeated_starts, suffix_array

SCHEMA = "doc_id long, text string"


def covered(raws, length):
    """For each text, which bytes lie in a string of ``length`` bytes that starts elsewhere too."""
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def spans(marks):
    edge = np.diff(np.r_[0, marks.astype(int), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    out = []
    for r, gone in zip(raws, covered(raws, length), strict=True):
        out.append((len(r), int(gone.sum()), len(spans(gone)), bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, k in ((1, 2), (2, 2), (50, 3), (400, 4), (3000, 3), (2000, 200)):
        t = np.r_[rng.integers(1, k, n), 0]
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffix_array(t, k + 1).tolist() == want
        assert suffix_array(t, k + 1, direct=8).tolist() == want


def test_repeated_starts():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    for starts in ([len(p) for p in parts], [len(p) // 2 for p in parts]):
        for length, found in zip((5, 9), repeated_starts(parts, np.array(starts), (5, 9)), strict=True):
            seen = {}
            for p, n in zip(parts, starts, strict=True):
                for i in range(min(n, len(p) - length + 1)):
                    seen[p[i : i + length]] = seen.get(p[i : i + length], 0) + 1
            for p, n, f in zip(parts, starts, found, strict=True):
                assert f.tolist() == [i + length <= len(p) and seen[p[i : i + length]] > 1 for i in range(n)]


@pytest.mark.parametrize(("group", "seed"), [(512, 1), (3, 2), (1, 3)])
def test_strip_is_brute_force(spark, group, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(14) for _ in range(3)]
    texts = [text(rng.randint(0, 30)) + rng.choice(shared)[rng.randint(0, 20) :] + text(rng.randint(0, 20)) for _ in range(30)]
    texts += [texts[0]] * 3 + [texts[1] + texts[1], texts[2][:90], texts[2][5:95], None, "", "ab" * 120, text(6)]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = repeats.strip(rows, length=40, group=group, refine=(8, 1), shard_bytes=2000).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found}
    for k, want in enumerate(brute(texts, 40)):
        assert got[k] == want, (k, texts[k])
    # where a string of 40 bytes repeats a block does, and where a block does a string of 24 bytes
    told = {r["doc_id"]: r["n_blocks"] for r in repeats.digest(rows, length=40, passage=40, block=24, shard_bytes=2000).collect()}
    raws = [(t or "").encode() for t in texts]
    for k, (long, short) in enumerate(zip(covered(raws, 40), covered(raws, 24), strict=True)):
        assert (told[k] > 0) >= long.any() and (told[k] > 0) <= short.any(), (k, texts[k])


def test_long_texts_and_one_hot_passage(spark):
    """Texts beyond a chunk share parts across its border; one passage stands in very many surroundings."""
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    part, hot = letters(3000), letters(410)
    texts = [letters(repeats.CHUNK - 1500) + part + letters(900), letters(50) + part[100:2900], letters(2 * repeats.CHUNK) + part[:450]]
    texts += [letters(60) + hot + letters(60) for _ in range(150)]
    got = {r["doc_id"]: r for r in repeats.strip(spark.createDataFrame(list(enumerate(texts)), SCHEMA), group=40).collect()}
    assert [(got[k]["n_removed"], got[k]["n_spans"]) for k in range(3)] == [(2900, 1), (2800, 1), (450, 1)]
    assert bytes(got[1]["kept"]).decode() == texts[1][:50]
    for k, want in enumerate(brute(texts[3:], 400), 3):
        assert (len(texts[k]), got[k]["n_removed"], got[k]["n_spans"], bytes(got[k]["kept"])) == want[:4]


def test_passages_below_the_length(spark):
    """A passage of 55 words and about 330 bytes is told but not removed; clean texts have none."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 6))) for _ in range(n))
    passage = words(55)
    texts = [f"{words(40)} {passage} {words(30)}" for _ in range(4)] + [words(120) for _ in range(4)]
    got = {r["doc_id"]: (r["n_blocks"] > 0, r["n_removed"]) for r in repeats.digest(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [got[k] for k in range(8)] == [(True, 0)] * 4 + [(False, 0)] * 4


def test_edges(spark):
    empty = repeats.digest(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_blocks"] and empty.count() == 0
    rows = spark.createDataFrame([(None, "x" * 30, 1), (1, None, 2), (1, "x" * 30, 3)], "doc_id long, text string, runs int")
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.strip(rows, length=20).collect()}
    assert got == {(None, 30, 30), (1, 0, 0), (1, 30, 30)}
    out = repeats.digest(rows, length=400).filter("n_bytes = 0").first()
    assert out["kept_sha256"] == hashlib.sha256(b"").hexdigest()
