"""Removal of long byte strings that occur more than once in a corpus, by suffix arrays over shards.

A string of ``length`` bytes has an *anchor*: the place of its smallest hashed 16-byte gram, leftmost on
ties. Equal strings have equal anchors, so strings that could be equal meet if text is dealt out by
anchor. Runs of starts with one anchor form a segment (the starts, and the bytes their strings cover).

1. A string reaches at least half of its other bytes to one side of its anchor, so a segment that shares
   neither the half before its anchor nor the half behind it cannot hold a repeat. A task counts the
   hashes of these halves by itself first, so that one of a very common passage leaves it once; the
   hashes that are counted twice or more in all name the texts and the segments to look at.
2. Segments of the same bytes under one anchor are entered once with their number: if there are two, all
   their strings have another start, whatever else the shard holds. An anchor with one such segment alone
   leaves nothing to be sorted.
3. Where more than ``group`` different segments share an anchor (a passage that very many documents
   hold, in as many surroundings), they are cut into blocks of ``refine`` starts and dealt by the bytes
   that all strings of a block share; blocks that are still too many together are cut into single
   strings, which can only meet their equals.
4. Shards of segments are sorted by induced sorting; permuted common prefixes of ``length`` or more
   mark the starts that repeat.
5. Marks go back to every different text by segment, and its bytes are dropped under the union of the
   marked strings; rows take the result of their text.

Shorter passages are told, not removed: every string of ``passage`` bytes holds one of some blocks of
``block`` bytes at steps from its anchor, and blocks whose hash stands twice are counted for their text.

Hashes deal text out; only equality of whole segments and of whole texts rests on them (128 bits), and the
count of blocks (64 bits).

Defined cases: null texts are empty; texts shorter than ``length`` keep all their bytes; texts of any
length go in overlapping chunks of ``CHUNK`` bytes; repeated rows are copies of each other and lose what
they share; null doc_ids are rows like any other; extra columns are ignored by ``strip``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.llm.common import materialize
from strophe.llm.suffixes import repeated_starts

GRAM = 16
CHUNK = 1 << 20
PLACE = np.uint64((1 << 21) - 1)  # enough bits for a place in a chunk
FLUSH = 1 << 20
UNIT = "key long, uid binary, many long, starts int, align int, content binary"
RUNS = "array<struct<begin:int,end:int>>"


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    odd = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (odd, pow(odd, -1, 2**64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _anchors(raw: bytes, length: int, block: int = 0) -> np.ndarray:
    """One column a segment of one chunk: anchor hash, anchor place, first start, last start, left, right.

    ``left`` and ``right`` hash the anchor with the half of a string before and behind it; 0 where no
    string has that much. With ``block``: hashes and places of the blocks of so many bytes, at steps of
    ``length - block`` bytes before the anchors, that lie in the strings of the segments.
    """
    words = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    span, half = length - GRAM + 1, (length - GRAM) // 2
    with np.errstate(over="ignore"):
        grams = _mixed((words[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)))
        n, starts = len(grams), len(raw) - length + 1
        # the least gram of each window, from running minima of blocks to both sides; its low bits are its place
        packed = np.full(-(-n // span) * span, np.uint64(2**64 - 1))
        packed[:n] = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)
        blocks = packed.reshape(-1, span)
        to_right = np.minimum.accumulate(blocks, axis=1).ravel()
        to_left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(to_left[:starts], to_right[span - 1 : span - 1 + starts])
        low = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
        high, place = np.r_[low[1:], starts] - 1, (least[low] & PLACE).astype(np.int64)
        power, inverse = _powers(CHUNK + (1 << 16))
        sums = np.r_[np.uint64(0), np.cumsum(grams * power[:n])]

        def side(begin: np.ndarray, there: np.ndarray, salt: int) -> np.ndarray:
            begin = np.where(there, begin, 0)
            end = np.minimum(begin + half + 1, n)
            return np.where(there, _mixed((sums[end] - sums[begin]) * inverse[begin] ^ np.uint64(salt)), np.uint64(0))

        if block:
            step = length - block
            first, last = (place - high) // step, (place - low) // step
            many = last - first + 1
            q = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            begin = np.repeat(place, many) - q * step
            return np.stack([_mixed((sums[begin + block - GRAM + 1] - sums[begin]) * inverse[begin]).view(np.int64), begin])

        left, right = side(place - half, low <= place - half, 1), side(place, high + length >= place + GRAM + half, 2)
    return np.stack([grams[place].view(np.int64), place, low, high, left.view(np.int64), right.view(np.int64)])


def _segments(text: bytes, length: int, block: int = 0) -> np.ndarray:
    """``_anchors`` of one text, with places in the text; a long one goes in overlapping chunks."""
    out = [np.zeros((2 if block else 6, 0), np.int64)]
    for at in range(0, len(text) - length + 1, CHUNK):
        part = _anchors(text[at : at + CHUNK + length - 1], length, block)
        part[1:4] += at
        out.append(part)
    return np.concatenate(out, axis=1)


def _counted(halves: list[np.ndarray], rows: list[np.ndarray]) -> pd.DataFrame:
    """Each half once with its number; those that repeat here name their rows, with the number 0."""
    half, row = np.concatenate(halves), np.concatenate(rows)
    order = np.argsort(half, kind="stable")
    half, row = half[order], row[order]
    first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
    size = np.diff(np.r_[first, len(half)])
    again = np.repeat(size > 1, size)
    more = pd.DataFrame({"half": half[again], "row": row[again]}).drop_duplicates().assign(n=0)
    return pd.concat([pd.DataFrame({"half": half[first], "row": row[first], "n": size}), more], ignore_index=True)


def _hashes(length: int, block: int = 0):
    """(half, row, n): what ``_counted`` makes of the halves of the segments, or of the blocks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        halves, rows, held = [], [], 0
        for b in batches:
            for raw, row in zip(b["raw"], b["row"], strict=True):
                own = _segments(raw, length, block)
                if block:  # two anchors may name one place
                    own = own[0, np.unique(own[1], return_index=True)[1]]
                else:
                    own = own[4:][own[4:] != 0]
                halves.append(own)
                rows.append(np.full(len(own), row))
                held += len(own)
                if held >= FLUSH:
                    yield _counted(halves, rows)
                    halves, rows, held = [], [], 0
        if held:
            yield _counted(halves, rows)

    return each


def _met(texts: DataFrame, length: int, block: int, name: str) -> DataFrame:
    """(row, half): the hashes of each text that are counted twice or more in all."""
    scanned = texts.filter(F.octet_length("raw") >= length).select("raw", "row").mapInPandas(_hashes(length, block), "half long, row long, n long")
    scanned = materialize(scanned, name)
    # at most a row of each flush for a half, however common it is
    met = scanned.filter("n > 0").withColumn("n", F.sum("n").over(W.partitionBy("half"))).filter("n > 1").select("row", "half")
    return met.union(scanned.filter("n = 0").select("row", "half"))


def _uid(key: int, align: int, starts: int, content: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(content, seed=(key ^ align ^ (starts << 40)) & (2**64 - 1))


def _units(length: int):
    """The segments of a text whose left or right half is asked for."""
    import xxhash

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw, tkey, many, halves in zip(b["raw"], b["tkey"], b["many"], b["halves"], strict=True):
                s = _segments(raw, length)
                for key, place, low, high in s[:4, np.isin(s[4:], np.asarray(halves, np.int64)).any(axis=0)].T.tolist():
                    content, starts, align = raw[low : high + length], high - low + 1, low - place + length
                    where = xxhash.xxh3_64_intdigest(tkey, seed=low)
                    out.append((key, _uid(key, align, starts, content), many, starts, align, content, tkey, low, where - (where >> 63 << 64)))
            yield pd.DataFrame(out, columns=["key", "uid", "many", "starts", "align", "content", "tkey", "low", "place"])

    return each


def _children(length: int, width: int):
    """Units of ``width`` starts, keyed by the bytes their strings share, with their parent."""
    import xxhash

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, uid, many, starts, align, content in zip(b["key"], b["uid"], b["many"], b["starts"], b["align"], b["content"], strict=True):
                first = -(align % width)  # blocks lie on a grid that hangs on the anchor
                for at in range(first, starts, width):
                    a, z = max(at, 0), min(at + width, starts)
                    core = content[at + width - 1 : at + length]  # lies in every string of the block, cut or not
                    child = xxhash.xxh3_64_intdigest(core, seed=(key + (align + at)) & (2**64 - 1))
                    child -= (child >> 63) << 64
                    own = content[a : z + length - 1]
                    out.append((child, _uid(child, a - at, z - a, own), many, z - a, a - at, own, bytes(uid), a))
            yield pd.DataFrame(out, columns=["key", "uid", "many", "starts", "align", "content", "parent", "at"])

    return each


def _marks(length: int):
    def shard(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("uid", ignore_index=True)
        (found,) = repeated_starts(b["content"].tolist(), b["starts"].to_numpy(), (length,))
        # of a segment that is there twice every string has another start
        out = [[(0, n)] if many > 1 else _runs(f) for f, n, many in zip(found, b["starts"], b["many"], strict=True)]
        return pd.DataFrame({"uid": b["uid"], "runs": out})

    return shard


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, marked.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _sorted_out(units: DataFrame, length: int, group: int, refine: tuple[int, ...], shard_bytes: int) -> DataFrame:
    """(uid, runs): the runs of marked starts of each unit that has any; ``units`` is written."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = units.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("many").alias("total")).filter("total > 1")
    stats = materialize(stats, "unit-keys")
    kept = units.join(stats, "key")
    out = None
    if refine and stats.filter(F.col("kinds") > group).limit(1).count():
        hot = materialize(kept.filter(F.col("kinds") > group).select(*units.columns), "hot-units")
        schema = f"{UNIT}, parent binary, at int"
        cut = materialize(hot.repartition(parts).mapInPandas(_children(length, refine[0]), schema), "cut-units")
        links = cut.select("uid", "parent", "at")
        same = [F.first(c).alias(c) for c in ("key", "starts", "align", "content")]
        below = materialize(cut.groupBy("uid").agg(F.sum("many").alias("many"), *same).select(*units.columns), "units")
        found = materialize(_sorted_out(below, length, group, refine[1:], shard_bytes), "child-marks")
        moved = F.transform("runs", lambda r: F.struct((r["begin"] + F.col("at")).alias("begin"), (r["end"] + F.col("at")).alias("end")))
        out = links.join(found, "uid").select(F.col("parent").alias("uid"), moved.alias("runs")).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        kept = kept.filter(F.col("kinds") <= group)
    volume = kept.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    # small shards while that gives every task some, full ones beyond
    shards = max(1, -(-volume // shard_bytes), min(4 * parts, -(-volume // max(1, shard_bytes // 16))))
    dealt = kept.select("uid", "many", "starts", "content", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    # sorting takes long for its bytes: small partitions are not to be put together
    marks = dealt.repartition(min(shards, 4 * parts), "shard").groupBy("shard").applyInPandas(_marks(length), f"uid binary, runs {RUNS}").filter(F.size("runs") > 0)
    return marks if out is None else marks.unionByName(out)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("raw"))
    return rows.withColumn("tkey", F.unhex(F.md5("raw"))).withColumn("row", F.xxhash64("raw")).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))


def _found(texts: DataFrame, length: int, group: int, refine: tuple[int, ...], shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The different texts that could hold a repeat, (tkey, raw), and the runs of bytes, (tkey, runs)."""
    hits = _met(texts, length, 0, "halves").groupBy("row").agg(F.collect_set("half").alias("halves"))
    each = texts.groupBy("row", "tkey").agg(F.count("*").alias("many"), F.min("doc").alias("doc"))
    asked = materialize(each.join(hits, "row").select("tkey", "doc", "many", "halves"), "asked")  # a list is bounded by its text
    held = materialize(texts.select("tkey", "doc", "raw").join(asked, ["tkey", "doc"]).drop("doc"), "held-texts")
    # a row that repeats gives its units again; their number is above 1 then without it
    units = materialize(held.mapInPandas(_units(length), f"{UNIT}, tkey binary, low int, place long"), "units")
    kinds = units.groupBy("key", "uid").agg(F.sum("many").alias("many"), F.min("place").alias("place"), F.min("starts").alias("starts"))
    kinds = materialize(kinds, "segment-kinds")
    mixed = kinds.groupBy("key").agg((F.count("*") > 1).alias("mixed"))
    kinds = materialize(kinds.join(mixed, "key"), "kinds")
    sure = kinds.filter("NOT mixed AND many > 1").select("uid", F.array(F.struct(F.lit(0).alias("begin"), F.col("starts").alias("end"))).alias("runs"))
    reps = units.drop("many").join(kinds.filter("mixed").select("uid", "place", "many"), ["uid", "place"]).select("key", "uid", "many", "starts", "align", "content")
    reps = materialize(reps.dropDuplicates(["uid"]), "representatives")
    marks = materialize(_sorted_out(reps, length, group, refine, shard_bytes).unionByName(sure), "marks")
    spans = units.select("uid", "tkey", "low").join(marks, "uid")
    runs = F.transform("runs", lambda r: F.struct((r["begin"] + F.col("low")).alias("begin"), (r["end"] + F.col("low") + (length - 1)).alias("end")))
    return held.select("tkey", "raw"), spans.select("tkey", runs.alias("runs")).groupBy("tkey").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def stripped(docs: DataFrame, length: int = 400, group: int = 512, refine: tuple[int, ...] = (16, 1), shard_bytes: int = 1 << 22) -> DataFrame:
    """(tkey, n_removed, n_spans, kept) of each different text (md5) that holds a repeat; written."""
    held, runs = _found(_texts(docs), length, group, refine, shard_bytes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tkey, raw, begin, end in zip(b["tkey"], b["raw"], b["begin"], b["end"], strict=True):
                gone = _union(list(zip(begin.tolist(), end.tolist(), strict=True)))
                kept = b"".join(raw[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(raw)], strict=True))
                out.append((tkey, len(raw) - len(kept), len(gone), kept))
            yield pd.DataFrame(out, columns=["tkey", "n_removed", "n_spans", "kept"])

    ends = runs.select("tkey", F.col("runs.begin").alias("begin"), F.col("runs.end").alias("end"))
    once = held.join(ends, "tkey").dropDuplicates(["tkey"])
    return materialize(once.mapInPandas(each, "tkey binary, n_removed long, n_spans long, kept binary"), "stripped")


def passages(docs: DataFrame, passage: int = 296, block: int = 216) -> DataFrame:
    """(row, n_blocks): for each text (by its 64-bit hash), its blocks that stand elsewhere or again."""
    return _met(_texts(docs), passage, block, "blocks").groupBy("row").agg(F.countDistinct("half").alias("n_blocks"))


def _each_row(rows: DataFrame, own: DataFrame, kept: str) -> DataFrame:
    """``rows`` with what their texts lose; texts that ``own`` does not have lose nothing."""
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_removed", "n_spans")]
    return rows.join(own, "tkey", "left").select("doc_id", "row", "n_bytes", *counts, F.coalesce("own", kept).alias(kept))


def strip(docs: DataFrame, length: int = 400, **kw) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row of ``docs`` with the bytes that remain."""
    rows = _texts(docs).select("doc_id", "row", "tkey", F.octet_length("raw").cast("long").alias("n_bytes"), F.col("raw").alias("kept"))
    return _each_row(rows, stripped(docs, length, **kw).withColumnRenamed("kept", "own"), "kept").drop("row")


def digest(docs: DataFrame, length: int = 400, passage: int = 296, block: int = 216, **kw) -> DataFrame:
    """``strip`` with the SHA-256 of the bytes that remain, and ``n_blocks``: no text is shuffled for it.

    ``n_blocks`` is above 0 where a passage of ``passage`` bytes (about fifty words) stands elsewhere too,
    removed or not.
    """
    rows = _texts(docs).select("doc_id", "row", "tkey", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("kept_sha256"))
    out = _each_row(rows, stripped(docs, length, **kw).withColumn("own", F.sha2("kept", 256)).drop("kept"), "kept_sha256")
    blocks = passages(docs, passage, block)
    return out.join(blocks, "row", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"))
