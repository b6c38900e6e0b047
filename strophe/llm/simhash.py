"""SimHash near-duplicate groups by pigeonhole blocks.

Fingerprints are cut into ``max_distance + agree`` blocks; two that differ in at most ``max_distance``
bits agree in ``agree`` whole blocks, so joining on every choice of ``agree`` blocks meets every close
pair. Candidates are verified by Hamming distance. ``agree`` follows the number of different
fingerprints, which keeps the expected bucket small at every size; the result does not depend on it.

Work is done on *different* fingerprints: copies collapse before anything is shuffled by block. Inside
a bucket only a spanning set of links leaves the task (at most one per member beyond direct
neighbours), never all pairs. A bucket with more than ``hot`` members is not compared pair by pair at
all: each member is sent to the fingerprints within ``max_distance / 2`` flips, where members that meet
are close by the triangle inequality and members that are close always meet.

Defined cases: a null or blank text has fingerprint zero and links like any other; rows with a null
``doc_id`` keep a fingerprint, take no part in links and have a null component; repeated rows and
other texts under the same id share their component; extra columns are ignored by ``near_duplicates``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialize
from strophe.llm.graph import components

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of 64-bit hashes: the bits that over half of them hold."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit fingerprint of one text; words are parted by ASCII white space."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z alone
    if not parts:
        return 0
    joined, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = np.array([h(joined, 42)], np.uint64)
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        begin, end = (ends - lengths)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
        hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin))
    return majority(hashes)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(t if isinstance(t, str) else None, words) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, "doc_id long, fp long")


def _bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, mask) of each block of a 64-bit fingerprint."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_keys(fps: DataFrame, max_distance: int, agree: int) -> DataFrame:
    """(choice, key, fp, node): a row for each choice of ``agree`` blocks."""
    blocks = _bounds(max_distance + agree)
    keys = []
    for k, choice in enumerate(combinations(blocks, agree)):
        key, width = F.lit(0).cast("long"), 0
        for shift, mask in choice:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)), width))
            width += mask.bit_length()
        keys.append(F.struct(F.lit(k).alias("choice"), key.alias("key")))
    return fps.select("fp", "node", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.key", "fp", "node")


def _within(fp: np.ndarray, node: np.ndarray, max_distance: int) -> list[np.ndarray]:
    """Spanning links of one bucket: breadth-first over the members not yet reached."""
    left, links = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= max_distance
            if near.any():
                found, left = left[near], left[~near]
                links.append(np.stack([np.full(len(found), node[at]), node[found]], 1))
                queue.extend(found.tolist())
    return links


def _links(max_distance: int, small: int = 32):
    """Links inside the buckets of a partition sorted by (choice, key, fp)."""

    def close(b: pd.DataFrame) -> pd.DataFrame:
        fp, node = b["fp"].to_numpy().view(np.uint64), b["node"].to_numpy()
        change = np.flatnonzero((np.diff(b["key"].to_numpy()) != 0) | (np.diff(b["choice"].to_numpy()) != 0)) + 1
        starts, ends = np.r_[0, change], np.r_[change, len(b)]
        group, size = np.repeat(np.arange(len(starts)), ends - starts), ends - starts
        out = []
        for off in range(1, min(small, int(size.max(initial=0)))):  # small buckets: every pair, many buckets at once
            i = np.flatnonzero((group[:-off] == group[off:]) & (size[group[:-off]] <= small))
            i = i[np.bitwise_count(fp[i] ^ fp[i + off]) <= max_distance]
            out.append(np.stack([node[i], node[i + off]], 1))
        for k in np.flatnonzero(size > small):
            out += _within(fp[starts[k] : ends[k]], node[starts[k] : ends[k]], max_distance)
        both = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"u": both.min(axis=1, initial=2**63 - 1), "v": both.max(axis=1, initial=-(2**63))}).drop_duplicates()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = (b["choice"] == b["choice"].iat[-1]) & (b["key"] == b["key"].iat[-1]) if len(b) else None
            if last is None or last.all():
                rest = b
                continue
            rest = b[last]  # the last bucket may go on in the next batch
            yield close(b[~last])
        if rest is not None and len(rest):
            yield close(rest)

    return each


def _flips(bits: int) -> list[int]:
    """Signed masks with at most ``bits`` ones."""
    masks = [sum(1 << k for k in c) for n in range(bits + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, count: int, max_distance: int = 4, hot: int = 4096) -> DataFrame:
    """(u, v) with u < v, node ids: enough verified links to give the components of all close pairs.

    ``fps``: (fp, node), a row for each different fingerprint; ``count``: how many there are.
    """
    agree = 1
    while agree < 6 and count > 2 ** (64 * agree // (max_distance + agree) - 1):
        agree += 1
    keys = block_keys(fps, max_distance, agree)
    full = keys.groupBy("choice", "key").count().filter(F.col("count") > hot)
    full = materialize(full, "hot-blocks")
    each = keys
    out = None
    if max_distance % 2 == 0 and full.limit(1).count():
        # members of full buckets, once each, to all fingerprints within half the distance
        full = F.broadcast(full) if full.count() <= 10_000 else full  # at most 10,000 rows of 20 bytes
        members = materialize(keys.join(full, ["choice", "key"], "left_semi").select("fp", "node").distinct(), "hot-members")
        each = keys.join(full, ["choice", "key"], "left_anti")
        masks = F.array(*[F.lit(m).cast("long") for m in _flips(max_distance // 2)])
        near = members.select("node", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
        least = near.groupBy("at").agg(F.min("node").alias("u"), F.count("*").alias("n")).filter("n > 1").drop("n")
        out = near.join(least, "at").filter("node > u").select("u", F.col("node").alias("v")).distinct()
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartition(parts, "choice", "key").sortWithinPartitions("choice", "key", "fp")
    found = dealt.mapInPandas(_links(max_distance), "u long, v long")
    return (found if out is None else found.unionByName(out)).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links between fingerprints with at
    most ``max_distance`` differing bits.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    fps = materialize(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fps")
    count = fps.count()
    # the smallest id of a fingerprint is its node; an id that repeats under other texts ties their nodes
    again = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b")
    tied = rows.join(again.select("doc_id"), "doc_id").join(fps, "fp").select(F.least("doc_id", "node").alias("u"), F.greatest("doc_id", "node").alias("v"))
    found = links(fps, count, max_distance).unionByName(tied.distinct())
    roots = components(found)
    named = fps.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "fp-roots")
    return rows.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the smallest doc_id, once.

    Among rows with that id the one with the smallest text stays. Rows with a null doc_id are kept.
    """
    return standing(docs, near_duplicates(docs, words, max_distance))


def standing(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component in ``named``, (doc_id, component_id)."""
    found = named.filter("doc_id != component_id").select(F.col("doc_id").alias("_other"))
    others = materialize(found.distinct(), "other-copies")
    kept = docs.join(others, docs["doc_id"].cast("long") == others["_other"], "left_anti")
    again = kept.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1 and _id is not null")
    again = materialize(again.select("_id"), "repeated-ids")
    if not again.limit(1).count():
        return kept
    some = kept.join(again, kept["doc_id"] == again["_id"], "left_semi")
    order = F.struct(F.col("text").isNotNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))  # a null text first
    once = some.groupBy("doc_id").agg(F.min_by(F.struct(*some.columns), order).alias("_row")).select("_row.*")
    return kept.join(again, kept["doc_id"] == again["_id"], "left_anti").unionByName(once)
