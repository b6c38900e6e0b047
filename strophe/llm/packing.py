"""Sequence packing by vector best-fit.

Every open sequence has a residual vector: tokens, documents and attention cost (the sum of squared
lengths) that it can still take. Pieces come longest first; among the sequences that can take a piece
under *every* constraint, ``rule`` "norm" picks the one whose weighted residual after the placement has
the smallest norm, "dot" the one whose residual has the largest weighted dot product with the piece's
own demands. Only when no sequence can take it, a new one is opened.

Pieces are dealt round-robin over shards, each packed in one task. A shard has ``shard_pieces`` of them, or
up to eight times as many where they are so short that those would fill fewer than 512 sequences; its
last sequence is what sharding costs, about one in a thousand.

Defined cases: a null text is empty and packs as the end id alone; null doc_ids and repeated rows are
packed like any other row; extra columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialize
from strophe.llm.tokens import encoder, release

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, kind: str, end_id: int, size: int = 4096) -> DataFrame:
    """Tokenized documents; those of more than ``size`` ids are cut, the others stay whole."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path, kind), np.array([end_id], "<u4")
        for b in batches:
            rows = iter(b["doc_id"])
            # a slice of ids is hashed and gone before the next one is made
            for part in encode.slices([t if isinstance(t, str) else "" for t in b["text"]]):
                out = []
                for own, doc_id in zip(part, rows):  # the slice ends first
                    ids = np.concatenate([own, end]).tobytes()
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        out.append((None if pd.isna(doc_id) else int(doc_id), k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        release()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(each, PIECES)


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length. ``capacity``: tokens, documents, attention cost."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free = np.zeros((len(lengths), 3))  # residuals of the sequences, opened one after the other
    open_ = np.zeros(0, np.int64)  # those that can still take something
    opened, scale = 0, weights / capacity**2
    for i in order.tolist():
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        left = free[open_] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            own = left[fits]
            score = (own * own) @ scale if rule == "norm" else -((own + need) @ (need * scale))
            at = int(open_[fits[int(score.argmin())]])
        else:
            at, free[opened], opened = opened, capacity, opened + 1
            open_ = np.append(open_, at)
        sequence[i], offset[i] = at, capacity[0] - free[at, 0]
        free[at] -= need
        if free[at].min() < 1:  # no piece has fewer than one token, document or unit of cost
            open_ = open_[open_ != at]
    return sequence, offset


def pack(
    cut: DataFrame, size: int = 4096, max_documents: int = 4096, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", shard_pieces: int = 8192,
) -> DataFrame:
    """``cut`` (see ``pieces``) with sequence_id and offset.

    The defaults of the document count and the attention cost (``size`` squared) leave the number of
    sequences to the tokens alone; smaller ones hold too, at the price of more sequences.
    """
    cut = materialize(cut, "pieces")
    n, tokens = cut.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    # enough pieces for some hundred sequences, however short they are, up to eight times as many
    shards = max(1, -(-n // (8 * shard_pieces)), min(-(-n // shard_pieces), -(-tokens // (512 * size))))
    capacity = np.array([size, max_documents, float(size) ** 2 if max_attention is None else max_attention])
    worth = np.array(weights)

    def shard(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        sequence, offset = best_fit(b["length"].to_numpy(), capacity, worth, rule)
        return b.drop(columns="shard").assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

    # the written table gives the same ids again if a task is repeated
    dealt = cut.withColumn("shard", F.monotonically_increasing_id() % shards)
    return dealt.groupBy("shard").applyInPandas(shard, f"{PIECES}, sequence_id long, offset long")
