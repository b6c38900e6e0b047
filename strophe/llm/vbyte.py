"""Token ids as files: frequency ranks in byte-aligned variable-length code with separate control bytes.

Ids are replaced by their frequency rank over the whole corpus, so that the frequent ones take one
byte. A block of consecutive documents holds its control bytes (two bits a value: its number of bytes
less one) apart from its data bytes. Blocks are written in ascending doc_id order as rows of Parquet,
which gives the format Spark's commit protocol and splits; ``ranks`` beside them has the id of each rank.
Decoding looks the four lengths of each control byte up in a table and gathers the data bytes at their
running sums.

Defined cases: a null text is empty and has the end id alone; rows with a null doc_id come first; rows
that share a doc_id follow each other, ordered by their ids; extra columns are ignored; an empty table
gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import fresh_path, materialize
from strophe.llm.tokens import encoder, release

#: For each control byte, the number of data bytes of its four values beyond their first.
EXTRA = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)
#: Bytes of a worker's caches: invented words are so many that smaller ones are emptied before a word comes again.
CACHE = 256 << 20
#: Characters that are looked up at once: a word costs one look-up in each slice that has it.
SLICE = 16 << 20
BLOCK_SCHEMA = "part int, block int, before long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    codes = (values > 0xFF).astype(np.uint8)
    codes += values > 0xFFFF
    codes += values > 0xFFFFFF
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = codes
    control = padded[::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    ends = np.cumsum(codes, dtype=np.int64) + np.arange(1, len(values) + 1)
    at, octets = ends - codes - 1, values.view(np.uint8).reshape(-1, 4)
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    data[at] = octets[:, 0]
    for k in range(1, int(codes.max(initial=0)) + 1):
        longer = np.flatnonzero(codes >= k)
        data[at[longer] + k] = octets[longer, k]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values that ``pack`` was given."""
    codes = EXTRA[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    octets = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(codes, dtype=np.int64)
    at += np.arange(count)
    at -= codes
    values = octets[at].astype(np.uint32)
    for k in range(1, int(codes.max(initial=0)) + 1):
        longer = np.flatnonzero(codes >= k)
        values[longer] |= octets[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


@dataclass
class TokenFiles:
    """Where the files lie."""

    blocks: str
    ranks: str


def tokenize(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """(doc_id, width, ids, counts): the ids of each whole text and the end id, ``width`` bytes each.

    Two bytes do for vocabularies of at most 65,536 entries. The last row of a task has no ids but
    ``counts``, how often each id came up in it (64-bit integers).
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    wide = "<u2" if size <= 1 << 16 else "<u4"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, total = encoder(path, kind, CACHE), np.array([end_id], wide), np.zeros(size, np.int64)
        for b in batches:
            at = 0
            for part in encode.slices([t if isinstance(t, str) else "" for t in b["text"]], SLICE):
                total += np.bincount(np.concatenate(part), minlength=size)
                total[end_id] += len(part)
                ids = [np.concatenate([x.astype(wide), end]).tobytes() for x in part]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at : at + len(part)], "width": int(wide[-1]), "ids": ids, "counts": None})
                at += len(part)
        release()
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "width": int(wide[-1]), "ids": [None], "counts": [total.tobytes()]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(each, "doc_id long, width int, ids binary, counts binary")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1, np.int64)
    for b in batches:
        for counts in b["counts"]:
            total = total + np.frombuffer(counts, np.int64)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"id": seen, "n": total[seen]})


def write(docs: DataFrame, path: str, kind: str, end_id: int, block_tokens: int = 1 << 17) -> TokenFiles:
    """Tokenize ``docs`` and write the files; only the counts of the vocabulary pass through the driver."""
    spark = docs.sparkSession
    rows = materialize(tokenize(docs, path, kind, end_id), "ids")
    counts = rows.filter("counts IS NOT NULL").select("counts").mapInPandas(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])  # at most a row for each entry of the vocabulary
    by_rank = ranked["id"].to_numpy(np.int64)
    files = TokenFiles(fresh_path(spark, "blocks"), fresh_path(spark, "ranks"))
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank}), "rank long, id long").coalesce(1).write.parquet(files.ranks)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    table = spark.sparkContext.broadcast(rank)  # 4 bytes for each entry of the vocabulary

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, held = [], [], 0

        def block() -> pd.DataFrame:
            control, data = pack(np.concatenate(ids))
            return pd.DataFrame({"part": [part], "block": [number], "before": [before], "doc_ids": [doc_ids], "n_tokens": [[len(x) for x in ids]], "control": [control], "data": [data]})

        for b in batches:
            for doc_id, width, raw in zip(b["doc_id"], b["width"], b["ids"], strict=True):
                ids.append(table.value[np.frombuffer(raw, f"<u{width}")])
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                held += len(ids[-1])
                if held >= block_tokens:
                    yield block()
                    number, before, ids, doc_ids, held = number + 1, before + held, [], [], 0
        if ids:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.filter("ids IS NOT NULL").select("doc_id", "width", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    # the payload is entropy-coded already byte by byte: a light codec over it
    ordered.mapInPandas(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(files.blocks)
    return files


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``ids`` little-endian unsigned 32-bit integers, in bytes."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(files.blocks)
    totals = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n")).orderBy("part").collect()
    first, at = {}, 0
    for r in totals:  # a row for each written partition
        first[r["part"]], at = at, at + r["n"]
    ranks = spark.read.schema("rank long, id long").parquet(files.ranks).orderBy("rank").toPandas()
    table = spark.sparkContext.broadcast((first, ranks["id"].to_numpy().astype("<u4")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, by_rank = table.value
        for b in batches:
            own = (b.column(c) for c in ("part", "before", "doc_ids", "n_tokens", "control", "data"))
            for part, before, doc_ids, lengths, control, data in zip(*own, strict=True):
                lengths = lengths.values.to_numpy()
                ids = by_rank[unpack(control.as_py(), data.as_py(), int(lengths.sum()))]
                ends = np.r_[0, np.cumsum(lengths)]
                rows = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])
                start = pa.array(first[part.as_py()] + before.as_py() + ends[:-1])
                yield pa.RecordBatch.from_arrays([doc_ids.values, start, pa.array(lengths), rows.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """``read`` with the crc32 of the ids in place of the ids."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


