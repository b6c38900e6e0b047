"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w x - theta_k): one weight vector for all grades, ordered thresholds. The score
is the expected severity, the sum of P(grade > k) over k.

The labels mark texts as toxic or not. Their grades are derived: 0 for a text that is not toxic; toxic ones
are ranked by the density of *markers* (words or stems much likelier in toxic texts of the sample) among
their terms, and cut into ``grades - 1`` parts of like numbers, so that every grade is filled. The density
takes the length of a text into account, which is no feature. ``Model.filled`` holds the numbers.

The vocabulary and the fit use a sample of at most ``train_rows`` labelled rows outside the held-out
fold; the vocabulary keeps at most ``max_words`` words by chi-squared. Every whole text is scored.

Defined cases: null and empty texts have no features; rows with a null doc_id are scored; null labels
are skipped; a document counts once for each of its labels, by its smallest text if its rows repeat; texts
of any length are read whole; without labels of both kinds the weights are zero and only the smoothed rate
remains; with fewer toxic texts than grades the upper grades stay empty;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.boosting import held_out

WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    filled: tuple[int, ...] = ()

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds, -30, 30)))


def terms(text: str | None) -> list[str]:
    """The words of one whole text, and the stems (first four and five letters) of the longer ones."""
    words = WORD.findall(text.lower()) if isinstance(text, str) else []
    long = [w for w in words if len(w) > 5]
    return words + ["^" + w[:4] for w in long] + ["^" + w[:5] for w in long]


def features(text: str | None, vocabulary: dict[str, int]) -> dict[int, int]:
    """Counts of the vocabulary's terms in one whole text."""
    found = Counter(filter(vocabulary.__contains__, terms(text)))
    return {vocabulary[w]: n for w, n in found.items()}


def _sparse(rows: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], np.int64)
    column = np.fromiter((k for r in rows for k in r), np.int64, int(n.sum()))
    value = np.log1p(np.fromiter((v for r in rows for v in r.values()), float, int(n.sum())))
    return np.repeat(np.arange(len(rows)), n), column, value


def fit(rows: list[dict[int, int]], grade: np.ndarray, words: int, grades: int, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the log-likelihood of the cumulative logits."""
    row, column, value = _sparse(rows)
    n, cuts = max(1, len(rows)), grades - 1
    over = np.array([((grade > k).sum() + 0.5) / (n + 1) for k in range(cuts)])
    start = -np.log(over / (1 - over))
    w, first, gaps = np.zeros(words), start[0], np.log(np.maximum(np.diff(start), 1e-2))
    state = [np.zeros(words + cuts), np.zeros(words + cuts)]
    for step in range(1, steps + 1 if len(rows) else 1):
        theta = first + np.r_[0, np.cumsum(np.exp(gaps))]
        m = np.bincount(row, w[column] * value, len(rows))
        s = 1 / (1 + np.exp(-np.clip(m[:, None] - theta, -30, 30)))
        edge = np.c_[np.ones(len(rows)), s, np.zeros(len(rows))]
        at = np.arange(len(rows))
        p = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-12)
        slope = edge * (1 - edge)
        # d log p / d margin, and with the opposite sign for the two thresholds around the grade
        lower, upper = slope[at, grade] / p, slope[at, grade + 1] / p
        dm = lower - upper
        dt = np.zeros((len(rows), cuts + 2))
        dt[at, grade] -= lower
        dt[at, grade + 1] += upper
        dt = dt[:, 1:-1].sum(axis=0)
        tail = dt[::-1].cumsum()[::-1]
        g = np.r_[-np.bincount(column, dm[row] * value, words) / n + l2 * w, -tail[0] / n, -tail[1:] * np.exp(gaps) / n]
        state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g]
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - move[:words], first - move[words], gaps - move[words + 1 :]
    return w, first + np.r_[0, np.cumsum(np.exp(gaps))]


def graded(toxic: np.ndarray, density: np.ndarray, grades: int) -> np.ndarray:
    """0 for texts that are not toxic, 1 to ``grades - 1`` by rank of density for the others; equal ones share a grade."""
    own = np.sort(density[toxic])
    cuts = own[[len(own) * k // (grades - 1) for k in range(1, grades - 1)]] if len(own) >= grades - 1 else own[:0]
    return np.where(toxic, 1 + np.searchsorted(cuts, density, "right"), 0).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, grades: int = 4, train_rows: int = 20_000, max_words: int = 4096, least_texts: int = 8) -> Model:
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    sample = own.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id")  # at most train_rows rows of 12 bytes
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most train_rows, however often rows repeat

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, toxic = Counter(), Counter()
            for text, y in zip(b["text"], b["y"], strict=True):
                words = set(terms(text))
                n.update(words)
                if y:
                    toxic.update(words)
            if n:  # an empty frame has no string column
                yield pd.DataFrame({"word": list(n), "n": list(n.values()), "toxic": [toxic[w] for w in n]})

    total, bad = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = bad / max(1, total)
    words = rows.mapInPandas(counted, "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    expected = F.col("n") * F.lit(rate)
    chi2 = (F.col("toxic") - expected) ** 2 / (expected * (1 - F.lit(rate)) + F.lit(1e-9))
    kept = words.filter(F.col("n") >= least_texts).withColumn("chi2", chi2).filter("chi2 > 10.8")
    kept = kept.orderBy(F.desc("chi2"), "word").limit(max_words).toPandas()
    vocabulary = {w: k for k, w in enumerate(kept["word"])}
    marker = ((kept["toxic"] / kept["n"]) > max(0.5, 2 * rate)).to_numpy(bool)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features(t, vocabulary) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "size": [len(terms(t)) for t in b["text"]], "at": [list(f) for f in found], "n": [list(f.values()) for f in found]})

    got = rows.mapInPandas(sparse, "doc_id long, y int, size long, at array<long>, n array<long>").toPandas()  # at most train_rows sparse rows
    got = got.sort_values(["doc_id", "y"], kind="stable", ignore_index=True)
    found = [dict(sorted(zip(map(int, a), map(int, n), strict=True))) for a, n in zip(got["at"], got["n"], strict=True)]
    density = np.array([sum(n for k, n in f.items() if marker[k]) for f in found], float) / np.maximum(got["size"].to_numpy(float), 1)
    grade = graded(got["y"].to_numpy(np.int64) == 1, density, grades)
    return Model(vocabulary, *fit(found, grade, len(vocabulary), grades), tuple(np.bincount(grade, minlength=grades).tolist()))


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) of every row; ``grade`` is the median."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, column, value = _sparse([features(t, model.vocabulary) for t in b["text"]])
            above = model.above(np.bincount(row, model.weights[column] * value, len(b)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "expected_severity": above.sum(axis=1), "grade": (above >= 0.5).sum(axis=1).astype("int32"), "p_toxic": above[:, 0], "toxic": (above[:, 0] >= least).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(each, "doc_id long, expected_severity double, grade int, p_toxic double, toxic int")
