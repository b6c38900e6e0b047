"""MinHash near copies with sequential Bayesian verification.

A text is the set of its hashed runs of ``words`` words. ``bands`` keys of ``rows`` minima each name the
candidates. A candidate pair then compares a second signature of ``checks`` minima in batches of ``BATCH``:
after each batch the posterior of its similarity under a uniform prior (a Beta distribution, so an exact sum
of binomial terms) tells how likely it still is to reach the bound, and the pair is dropped once that is
below ``miss``. What survives is verified on the full sets, so a link is never a guess. A pair of similarity
s shares no key with probability (1 - s ** rows) ** bands, 0.00007 at 0.8, and is dropped with about
``miss`` for each batch there.

Texts with the same set collapse first. A bucket is cut into chunks of about ``CHUNK`` members; members are
compared with the smallest one of their chunk and those with the smallest of the bucket. Only buckets whose
members still lie in different components go on, and there only pairs of different components: members
outside the largest one against all, chunk against chunk. A task gives the members that have a surviving
partner, and a second one verifies these on their sets, so that neither holds a whole large bucket and no
table all its pairs.

Defined cases: null texts and texts without words have the empty set and link with nothing; a text of fewer
than ``words`` words is one run; rows with a null ``doc_id`` have a null component, take no part and are
kept; rows that repeat an id share its component, which ties their texts; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialize
from strophe.llm.graph import components
from strophe.llm.near import _mixed, shingles

BATCH = 32
CHUNK = 512
#: Shingles that are hashed at once, so that they stay in the processor's cache.
PART = 512
#: Shingles of a chunk, so that very long texts come in smaller chunks.
WEIGHT = 1 << 21


def least_matches(n: int, similarity: float, miss: float) -> int:
    """The fewest matches of ``n`` minima with which the similarity may still reach ``similarity``.

    Under a uniform prior the posterior after m matches is Beta(m + 1, n - m + 1), whose mass above t is the
    chance of at most m successes among n + 1 trials of t.
    """
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def bounds(checks: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    """(minima compared, matches needed) after each batch."""
    return [(n, least_matches(n, similarity, miss)) for n in range(BATCH, checks + 1, BATCH)]


def survives(a: np.ndarray, b: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of ``a`` and ``b``, signatures of pairs, are still possible after the last batch."""
    at, got, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, need in needs:
        got = got + (a[at, done:n] == b[at, done:n]).sum(1)
        at, got, done = at[got >= need], got[got >= need], n
    return at


def _possible(row: np.ndarray, others: np.ndarray, at: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``at``, rows of ``others``, are still possible beside ``row``."""
    got, done = np.zeros(len(at), np.int64), 0
    for n, need in needs:
        got = got + (others[at, done:n] == row[done:n]).sum(1)
        at, got, done = at[got >= need], got[got >= need], n
        if not len(at):
            break
    return at


def described(docs: DataFrame, words: int, bands: int, rows: int, checks: int) -> DataFrame:
    """(doc_id, own, n, keys, signature) of every row; ``own`` stands for its set, null for the empty one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        rng = np.random.default_rng(7)
        total = bands * rows + checks
        flips, factors = (rng.integers(0, 2**32, (total, 1), np.uint32) for _ in range(2))
        factors |= np.uint32(1)
        for b in batches:
            names, sizes, keys, signatures = [], [], [], []
            for text in b["text"]:
                if not isinstance(text, str) or not text.strip(" \t\n\v\f\r"):
                    for column, none in ((names, None), (sizes, 0), (keys, None), (signatures, None)):
                        column.append(none)
                    continue
                own = shingles(text, words)
                half, least = (own >> np.uint64(32)).astype(np.uint32), np.full(total, 2**32 - 1, np.uint32)
                for a in range(0, len(own), PART):
                    least = np.minimum(least, ((half[a : a + PART] ^ flips) * factors).min(1))
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for column in least[: bands * rows].reshape(bands, -1).T:
                    key = _mixed(key + column)
                signature = least[bands * rows :].astype("<u2").tobytes()
                names.append(int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64)))
                sizes.append(len(own))
                keys.append(key.view(np.int64))
                signatures.append(signature)
            # nullable integers: a float would lose digits beside a null
            yield pd.DataFrame({"id": b["id"], "known": b["known"], "own": pd.array(names, "Int64"), "n": np.array(sizes, np.int64), "keys": keys, "signature": signatures})

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").cast("long").isNotNull().alias("known"), F.col("text").cast("string"))
    made = texts.mapInPandas(each, "id long, known boolean, own long, n long, keys array<long>, signature binary")
    return made.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "own", "n", "keys", "signature")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(own, runs) of every row with words."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            sets = [shingles(t, words) for t in b["text"] if isinstance(t, str) and t.strip(" \t\n\v\f\r")]
            names = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).view(np.int64)) for s in sets]
            yield pd.DataFrame({"own": pd.Series(names, dtype="int64"), "runs": [s.view(np.int64) for s in sets]})

    return docs.select(F.col("text").cast("string")).mapInPandas(each, "own long, runs array<long>")


def _matrix(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u2").reshape(len(signatures), -1) if len(signatures) else np.zeros((0, 0), np.uint16)


def _pruned(needs: list[tuple[int, int]]):
    """(u, v) of the candidate pairs that survive."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.iloc[survives(_matrix(b["su"]), _matrix(b["sv"]), needs) if len(b) else []][["u", "v"]]

    return each


def _alike(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _sides(b: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return b[b["side"] == 0].reset_index(drop=True), b[b["side"] == 1].reset_index(drop=True)


def _partners(left: pd.DataFrame, right: pd.DataFrame, needs: list[tuple[int, int]], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(left row, right rows) that survive: of different components, of possible sizes, each pair in one task alone."""
    ls, rs = _matrix(left["signature"]), _matrix(right["signature"])
    n, own, root, minor = (right[c].to_numpy() for c in ("n", "own", "root", "minor"))
    for i, (size, name, top) in enumerate(zip(left["n"].tolist(), left["own"].tolist(), left["root"].tolist(), strict=True)):
        some = (root != top) & (np.minimum(n, size) * 100 >= np.maximum(n, size) * percent) & (~minor | (own > name))
        found = _possible(ls[i], rs, np.flatnonzero(some), needs)
        if len(found):
            yield i, found


def _surviving(needs: list[tuple[int, int]], percent: int):
    """The rows of a task that have a surviving partner in it."""

    def each(b: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(b)
        ls, rs = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for i, found in _partners(left, right, needs, percent):
            ls[i] = True
            rs[found] = True
        return pd.concat([left[ls], right[rs]], ignore_index=True)

    return each


def _verified(needs: list[tuple[int, int]], percent: int):
    """Links between the components of a task's rows, by exact similarity."""

    def each(b: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(b)
        runs = [[np.asarray(x) for x in side["runs"]] for side in (left, right)]
        root, _ = pd.factorize(pd.concat([left["root"], right["root"]], ignore_index=True))
        at, out = len(left), []
        for i, found in _partners(left, right, needs, percent):
            for j in found.tolist():
                if root[i] == root[at + j]:
                    continue
                x, y = runs[0][i], runs[1][j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * 100 >= (len(x) + len(y) - both) * percent:
                    out.append((left["own"].iat[i], right["own"].iat[j]))
                    root[root == root[at + j]] = root[i]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return each


def _chunks(members: Column, shingled: Column) -> Column:
    return F.greatest(F.ceil(members / CHUNK), F.ceil(shingled / WEIGHT), F.lit(1)).cast("int")


def _links(sets: DataFrame, docs: DataFrame, words: int, similarity: float, checks: int, miss: float) -> DataFrame:
    """(u, v) names of sets: enough verified links to give the components of all candidates that are alike."""
    needs, percent = bounds(checks, similarity, miss), round(similarity * 100)
    marks = sets.select("own", "signature")
    keyed = sets.select("own", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("own").alias("first"), F.count("*").alias("size"), F.sum("n").alias("weight")).filter("size > 1")
    chunk = F.pmod(F.xxhash64("own"), _chunks(F.col("size"), F.col("weight")))
    members = materialize(keyed.join(shared, "key").withColumn("chunk", chunk), "bucket-members")
    centres = members.groupBy("key", "chunk").agg(F.min("own").alias("centre"))
    near = members.join(centres, ["key", "chunk"]).select(F.explode(F.array(F.struct(F.col("centre").alias("u"), F.col("own").alias("v")), F.struct(F.col("first").alias("u"), F.col("centre").alias("v")))).alias("p")).select("p.u", "p.v")
    near = near.filter("u != v").distinct()
    signed = near.join(marks.select(F.col("own").alias("v"), F.col("signature").alias("sv")), "v").join(marks.select(F.col("own").alias("u"), F.col("signature").alias("su")), "u")
    kept = materialize(signed.select("u", "v", "su", "sv").mapInPandas(_pruned(needs), "u long, v long"), "survivors")

    def full(owners: DataFrame) -> DataFrame:
        """(own, runs) of the named sets, worked out from their texts again."""
        wanted = sets.join(owners, "own", "left_semi").select(F.col("node").alias("_node")).distinct()
        texts = docs.join(wanted, docs["doc_id"].cast("long") == wanted["_node"], "left_semi")
        return materialize(_sets(texts, words).join(owners, "own", "left_semi").dropDuplicates(["own"]), "full-sets")

    some = full(kept.select(F.col("u").alias("own")).union(kept.select("v")).distinct())
    pairs = kept.join(some.select(F.col("own").alias("v"), F.col("runs").alias("rv")), "v").join(some.select(F.col("own").alias("u"), F.col("runs").alias("ru")), "u")
    found = materialize(pairs.filter(_alike(F.col("ru"), F.col("rv"), percent)).select("u", "v"), "links")

    # buckets that still hold several components, one of those with the same members
    tops = components(found).select(F.col("node").alias("own"), "root")
    placed = materialize(members.filter("size > 2").join(tops, "own", "left").select("key", "own", "n", F.coalesce("root", "own").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("own")).alias("x"))
    torn = parts.groupBy("key").agg(F.max(F.struct("c", "root", "w")).alias("major"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.bit_xor("x").alias("same"), F.count("*").alias("parts")).filter("parts > 1")
    torn = torn.groupBy("c", "same").agg(F.min(F.struct("key", "major", "w")).alias("t"))
    torn = torn.select("t.key", F.col("t.major.root").alias("major"), _chunks(F.col("c") - F.col("t.major.c"), F.col("t.w") - F.col("t.major.w")).alias("lefts"), _chunks(F.col("c"), F.col("t.w")).alias("rights"))
    left = placed.join(torn, "key").withColumns({"minor": F.col("root") != F.col("major"), "a": F.pmod(F.xxhash64("own"), F.col("lefts")).cast("int"), "b": F.pmod(F.xxhash64("own"), F.col("rights")).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.filter("minor").select("key", "own", "n", "root", "minor", "a", every("rights").alias("b"), F.lit(0).alias("side"))
    other = left.select("key", "own", "n", "root", "minor", every("lefts").alias("a"), "b", F.lit(1).alias("side"))
    dealt = one.unionByName(other).join(marks, "own").select("key", "a", "b", "side", "own", "n", "root", "minor", "signature")
    schema = "key long, a int, b int, side int, own long, n long, root long, minor boolean, signature binary"
    alive = materialize(dealt.groupBy("key", "a", "b").applyInPandas(_surviving(needs, percent), schema), "bucket-survivors")
    more = alive.join(full(alive.select("own").distinct()), "own").groupBy("key", "a", "b").applyInPandas(_verified(needs, percent), "u long, v long")
    return found.union(materialize(more.distinct(), "more-links"))


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 5, checks: int = 128, miss: float = 1e-5,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over texts of which each has a Jaccard
    similarity of ``similarity``, in whole percent, or more with the next; ``kept`` marks the rows with it.
    """
    every = materialize(described(docs, words, bands, rows, checks), "described")
    named = every.filter("own is not null and doc_id is not null")
    sets = materialize(named.groupBy("own").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("keys").alias("keys"), F.min("signature").alias("signature")), "sets")
    links = _links(sets, docs, words, similarity, checks, miss)
    nodes = sets.select("own", "node")
    ends = links.join(nodes.select(F.col("own").alias("u"), F.col("node").alias("a")), "u").join(nodes.select(F.col("own").alias("v"), F.col("node").alias("b")), "v")
    of_rows = materialize(every.select("doc_id", "own", "n").join(nodes, "own", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "row-nodes")
    # an id that repeats under other texts ties their sets
    tied = of_rows.filter("node != doc_id").select("doc_id", "node").distinct()
    again = of_rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x != y").select("doc_id")
    edges = ends.select("a", "b").union(tied.join(again, "doc_id").select("doc_id", "node")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    top = components(edges)
    out = of_rows.join(top, "node", "left")
    component = F.coalesce("root", "node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component, as ``simhash.deduplicate`` keeps them."""
    from strophe.llm.simhash import standing

    return standing(docs, near_duplicates(docs, **kw).filter("doc_id is not null").select("doc_id", "component_id").distinct())
