"""Histogram gradient-boosted trees, flattened into arrays, and the document quality classifier.

Trees are complete and of equal depth, stored in heap order (children of node i at 2i+1 and 2i+2), so
a batch of rows walks all trees at once with a few numpy gathers.

The classifier is fitted on a sample of at most ``train_rows`` labelled rows, chosen by a hash of the
id; it scores every whole text. Inputs of a score are statistics of the text alone.

Defined cases: null and empty texts have the statistics of an empty text and get a score; rows with a
null doc_id are not held out; null labels are skipped; a document counts once for each of its labels, by
its smallest text if its rows repeat; texts of any length are read whole; a
sample with one class or none gives a constant score (its smoothed rate, 0.5 without labels); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "lower", "digit", "space", "high", "dot", "bang", "pipe", "symbol",
    "entropy", "distinct_words", "distinct_lines", "line_length", "short_words", "upper_words", "marked_words", "top_byte", "distinct_pairs",
)
_CLASS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 13, 32), "high": range(128, 256),
    "dot": b".,;:?", "bang": b"!", "pipe": b"|", "symbol": b"#$%&*+/<=>@\\^_`{}~[]()\"'-",
}
_MASK = np.array([np.isin(np.arange(256), list(v)) for v in _CLASS.values()]).astype(float).T


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one whole text."""
    text = text if isinstance(text, str) else ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, lines = text.split(), text.split("\n")
    size, n = max(1, len(raw)), max(1, len(words))
    share = np.bincount(raw, minlength=256) / size
    some = share[share > 0]
    length = np.fromiter(map(len, words), np.int64, len(words))
    odd = sum(not w[-1].isalnum() for w in words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(length.mean()) if words else 0.0, *(share @ _MASK).tolist(),
        float(-(some * np.log(some)).sum()), len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)),
        float((length <= 3).sum()) / n, sum(map(str.isupper, words)) / n, odd / n, float(share.max()), len(set(zip(words, words[1:], strict=False))) / n,
    ]


@dataclass
class Forest:
    """Trees x nodes arrays; ``value`` holds the leaves, left to right."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        trees, inner = self.feature.shape
        node, each, row = np.zeros((len(x), trees), np.int64), np.arange(trees)[None, :], np.arange(len(x))[:, None]
        while (node[:1] < inner).any():
            node = 2 * node + 1 + (x[row, self.feature[each, node]] > self.threshold[each, node])
        return self.base + self.value[each, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic loss, second-order leaves, quantile bins, level by level."""
    inner, leaves = 2**depth - 1, 2**depth
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    width = bins + 1
    flat = code + np.arange(x.shape[1]) * width
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = (node - first)[:, None] * (x.shape[1] * width) + flat
            hist = [np.bincount(at.ravel(), np.repeat(v, x.shape[1]), many * x.shape[1] * width).reshape(many, x.shape[1], width).cumsum(2) for v in (g, h)]
            (gl, hl), (gs, hs) = hist, (a[:, :, -1:] for a in hist)
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(hl < least) | (hs - hl < least)] = 0
            best = gain[:, :, :-1].reshape(many, -1).argmax(1)
            f, b = best // (width - 1), best % (width - 1)
            for k in range(many):
                ok = gain[k, f[k], b[k]] > 1e-9 and b[k] < len(cuts[f[k]])
                feature[t, first + k], threshold[t, first + k] = f[k], cuts[f[k]][b[k]] if ok else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += value[t][leaf]
    return Forest(feature, threshold, value, base)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 20_000) -> Forest:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    sample = own.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id")  # at most train_rows rows of 12 bytes
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most train_rows, however often rows repeat
    got = rows.mapInPandas(each, "y int, doc_id long, x array<double>").toPandas()
    got = got.assign(key=[tuple(v) for v in got["x"]]).sort_values(["doc_id", "y", "key"], ignore_index=True)
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]], float).reshape(-1, len(FEATURES))
            s = forest.score(x)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(each, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more."""

    @F.pandas_udf("double")
    def worth(text: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.array([statistics(t) for t in text], float).reshape(-1, len(FEATURES))))

    return docs.filter(worth(F.col("text").cast("string")) >= least)
