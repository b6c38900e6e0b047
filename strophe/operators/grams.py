"""A substring index: which texts hold which three characters in a row.

``postings`` has one row a (gram, block), a block being some thousand texts that were read together, with
their places in the block. Sorted by gram, a search for a few grams skips all row groups without them. A
needle's candidates are the texts that hold its rarest grams; they are verified on the text itself, so the
index decides how much is read, never what is found. Two blanks at the end let every character start a gram
(flat texts have no blanks), so that needles of two characters are found by the grams that begin with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 3
#: Grams of a needle that are looked up, the rarest ones.
PICKS = 3
#: Texts and characters of a block.
BLOCK_ROWS, BLOCK_POINTS = 8192, 1 << 21


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first, points, members, grams = None, 0, [], []

    def made() -> pd.DataFrame:
        keys, member = np.concatenate(grams), np.repeat(np.array(members, np.int16), [len(g) for g in grams])
        order = np.argsort(keys, kind="stable")
        keys, member = keys[order], member[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        names = ["".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in keys[starts].tolist()]
        return pd.DataFrame({"gram": names, "block": first, "members": np.split(member, starts[1:])})

    for b in batches:
        for row, text in zip(b["row"].tolist(), b["text"], strict=True):
            if not text:
                continue
            x = np.frombuffer((text + "  ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            own = np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:])
            if first is not None and (not 0 < row - first < 1 << 15 or len(members) >= BLOCK_ROWS or points >= BLOCK_POINTS):
                yield made()
                first, points, members, grams = None, 0, [], []
            first = row if first is None else first
            members.append(row - first)
            grams.append(own)
            points += len(x)
    if first is not None:
        yield made()


def postings(texts: DataFrame) -> DataFrame:
    """(gram, block, members) of (row, text): the texts with ``gram`` are the rows ``block`` + member.

    ``row``: a different long for each text; texts that are read together should have close ones.
    """
    return texts.select("row", "text").mapInPandas(_blocks, "gram string, block long, members array<smallint>")


def counts(index: DataFrame) -> DataFrame:
    """(gram, df): in how many texts each gram stands."""
    return index.groupBy("gram").agg(F.sum(F.size("members")).alias("df"))


def picked(needles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(needle, gram, need): the rarest grams of each needle that has all its grams somewhere.

    A candidate has ``need`` of them; a needle shorter than a gram takes any gram that begins with it.
    """
    size = F.length("needle")
    long = needles.filter(size >= SIZE).select("needle", F.array_distinct(F.transform(F.sequence(F.lit(1), size - SIZE + 1), lambda i: F.substr(F.col("needle"), i, F.lit(SIZE)))).alias("grams"))
    known = long.select("needle", F.size("grams").alias("all"), F.explode("grams").alias("gram")).join(dictionary, "gram")
    best = known.groupBy("needle", "all").agg(F.count("*").alias("have"), F.slice(F.array_sort(F.collect_list(F.struct("df", "gram"))), 1, PICKS).alias("best")).filter(F.col("have") == F.col("all"))
    rare = best.select("needle", F.explode("best.gram").alias("gram"), F.size("best").alias("need"))
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(SIZE - 1)), lambda n: F.substr(F.col("gram"), F.lit(1), n)))
    begun = dictionary.select("gram", starts.alias("needle")).join(needles.filter(size < SIZE), "needle")
    return rare.unionByName(begun.select("needle", "gram", F.lit(1).alias("need")))


def candidates(index: DataFrame, picks: DataFrame) -> DataFrame:
    """(needle, row) of the texts that hold the picked grams."""
    parts = index.join(picks, "gram").groupBy("needle", "block").agg(F.collect_list("members").alias("lists"), F.first("need").alias("need"))
    every = F.aggregate(F.slice("lists", 2, PICKS), F.get("lists", F.lit(0)), lambda kept, x: F.array_intersect(kept, x))
    rows = F.when(F.col("need") == 1, F.array_distinct(F.flatten("lists"))).when(F.size("lists") == F.col("need"), every)
    return parts.select("needle", "block", F.explode(rows).alias("member")).select("needle", (F.col("block") + F.col("member")).alias("row"))
