"""Near copies by word shingles: SimHash and banded minima for candidates, exact Jaccard similarity for links.

A text is the set of its hashed runs of ``words`` words (parted by ASCII white space, A-Z lower-cased).
Texts with the same set collapse first. The majority bits of its runs, repeats included, are its SimHash
fingerprint; pigeonhole blocks and the Hamming check of ``simhash.links`` name as candidates what differs in
at most ``max_distance`` bits. Texts of similarity 0.8 differ in about ten bits, which blocks of 64 bits
cannot reach: what lies beyond is found by minima. ``bands`` keys of ``rows`` minima each name the candidates: a
pair of similarity s shares no key with probability (1 - s ** rows) ** bands, 0.00007 at 0.8.

Inside a bucket every member is compared with the smallest one; only buckets whose members still lie in
different components are compared further, by every pair of different components. Such a bucket is dealt
over chunks of about ``CHUNK`` members and a task compares two chunks, so that no task holds a whole large
bucket and no table all its pairs.

Defined cases: as in ``simhash``. Null and blank texts share the empty set and are copies of each other;
a text of fewer than ``words`` words is one run; rows with a null ``doc_id`` take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm import simhash
from strophe.llm.common import materialize
from strophe.llm.graph import components
from strophe.llm.tokens import release

PART = 1 << 13
CHUNK = 512


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def every_run(text: str | None, words: int) -> np.ndarray:
    """The hashes of the runs of ``words`` words of one text, repeats included."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z alone
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    runs = np.zeros(len(parts) - words + 1, np.uint64)
    for k in range(words):
        runs = _mixed(runs + each[k : len(parts) - words + 1 + k])
    return runs


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``words`` words of one text."""
    return np.unique(every_run(text, words))


def _keys(own: np.ndarray, flips: np.ndarray, factors: np.ndarray, bands: int) -> np.ndarray:
    """One key a band: the minima of its rows under different orders of the hashes."""
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for a in range(0, len(own), PART):
        least = np.minimum(least, ((own[a : a + PART][None] ^ flips[:, None]) * factors[:, None]).min(1))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, -1).T:
        key = _mixed(key + column)
    return key.view(np.int64)


def described(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, own, fp, keys): a row for each row of ``docs``; ``own`` stands for its set, ``fp`` is its fingerprint."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(5)
        flips, factors = (rng.integers(0, 2**64, bands * rows, np.uint64) for _ in range(2))
        factors |= np.uint64(1)
        for b in batches:
            own, fp, keys = [], [], []
            for t in b["text"]:
                runs = every_run(t if isinstance(t, str) else None, words)
                fp.append(simhash.majority(runs))
                own.append(_named(runs := np.unique(runs)))
                keys.append(_keys(runs, flips, factors, bands))
            yield pd.DataFrame({"doc_id": b["doc_id"], "own": own, "fp": fp, "keys": keys})
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, "doc_id long, own long, fp long, keys array<long>")


def _named(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(own, runs) of every row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t if isinstance(t, str) else None, words) for t in b["text"]]
            yield pd.DataFrame({"own": [_named(s) for s in sets], "runs": [s.view(np.int64) for s in sets]})
        release()

    return docs.select(F.col("text").cast("string")).mapInPandas(each, "own long, runs array<long>")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 1000 >= (F.size(a) + F.size(b) - both) * round(similarity * 1000)


def _bucket_links(similarity: float):
    """Links between the components of one bucket, by exact similarity."""
    permille = round(similarity * 1000)

    def each(b: pd.DataFrame) -> pd.DataFrame:
        b = b.assign(n=[len(x) for x in b["runs"]]).sort_values("n")
        own, n, runs = b["own"].tolist(), b["n"].tolist(), [np.asarray(x) for x in b["runs"]]
        root = pd.factorize(b["root"])[0]
        chunk = b["chunk"].to_numpy()
        other = chunk.min() != chunk.max()  # of two chunks, pairs inside of one are another task's
        out = []
        for i in range(len(own)):
            ahead = (root[i + 1 :] != root[i]) & ((chunk[i + 1 :] != chunk[i]) if other else True)
            for j in (np.flatnonzero(ahead) + i + 1).tolist():
                if n[i] * 1000 < n[j] * permille:
                    break
                if root[i] == root[j]:
                    continue
                both = len(np.intersect1d(runs[i], runs[j], assume_unique=True))
                if both * 1000 >= (n[i] + n[j] - both) * permille:
                    out.append((min(own[i], own[j]), max(own[i], own[j])))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return each


def _simhash_pairs(every: DataFrame, max_distance: int) -> DataFrame:
    """(u, v) names of sets: a spanning set of the pairs whose fingerprints differ in at most ``max_distance`` bits."""
    prints = every.select("fp", "own").distinct()
    fps = materialize(prints.groupBy("fp").agg(F.min("own").alias("node")), "fps")
    equal = prints.join(fps, "fp").filter("own != node").select(F.col("node").alias("u"), F.col("own").alias("v"))
    return materialize(simhash.links(fps, fps.count(), max_distance).unionByName(equal), "simhash-pairs")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 5, max_distance: int = 4) -> DataFrame:
    """(doc_id, component_id): a row for each row of ``docs`` with a doc_id.

    ``component_id`` is the smallest doc_id that can be reached over texts of which each has a Jaccard
    similarity of ``similarity`` or more with the next.
    """
    every = materialize(described(docs.filter("doc_id is not null"), words, bands, rows), "shingled")
    names = materialize(every.groupBy("own").agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys")), "sets")
    keyed = names.select("own", "node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(keyed.join(shared, "key"), "bucket-members")
    alike = _simhash_pairs(every, max_distance)
    close = members.filter("own != first").select(F.col("first").alias("u"), F.col("own").alias("v")).union(alike).distinct()
    # the sets of candidates alone, worked out from their texts again
    paired = alike.select(F.explode(F.array("u", "v")).alias("own")).distinct()
    wanted = members.select("node").union(names.join(paired, "own", "left_semi").select("node")).select(F.col("node").alias("_node")).distinct()
    texts = docs.join(wanted, docs["doc_id"].cast("long") == wanted["_node"], "left_semi")
    sets = materialize(_sets(texts, words).dropDuplicates(["own"]), "bucket-sets")
    one, other = (sets.select(F.col("own").alias(k), F.col("runs").alias(f"{k}_runs")) for k in "uv")
    pairs = close.join(other, "v").join(one, "u")
    found = materialize(pairs.filter(_alike(F.col("u_runs"), F.col("v_runs"), similarity)).select("u", "v"), "links")
    roots = components(found)
    placed = members.filter("n > 2").join(roots.select(F.col("node").alias("_own"), "root"), F.col("own") == F.col("_own"), "left")
    placed = materialize(placed.select("key", "own", F.coalesce("root", "own").alias("root")), "placed")
    # buckets that still hold several components, one of those with the same members
    torn = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("own")).alias("same")).filter("a != b")
    torn = torn.groupBy("n", "same").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    left = placed.join(torn, "key").withColumn("chunk", F.pmod(F.xxhash64("own"), F.col("chunks")).cast("int"))
    left = left.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left = left.select("key", "own", "root", "chunk", F.least("chunk", "_other").alias("a"), F.greatest("chunk", "_other").alias("b")).join(sets, "own")
    more = materialize(left.groupBy("key", "a", "b").applyInPandas(_bucket_links(similarity), "u long, v long").distinct(), "more-links")
    # sets stand for their smallest doc_id; an id that repeats under other texts ties its sets
    ids = names.select("own", "node")
    named = found.union(more).join(ids.select(F.col("own").alias("u"), F.col("node").alias("a")), "u").join(ids.select(F.col("own").alias("v"), F.col("node").alias("b")), "v")
    of_rows = materialize(every.select("doc_id", "own").join(ids, "own").select("doc_id", "node").distinct(), "row-nodes")
    tied = of_rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).filter("a != b")
    tied = tied.select(F.explode("all").alias("b"), "a").select("a", "b")
    edges = named.select("a", "b").union(tied).filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    top = components(edges)
    return of_rows.join(top, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their component, as ``simhash.deduplicate`` keeps them."""
    return simhash.standing(docs, near_copies(docs, words, similarity))
