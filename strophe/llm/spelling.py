r"""Spelling variants: words one edit apart, found in forward and backward minimal automata.

Two words one inserted, deleted or replaced code point apart agree in the first half of either one or in
all that follows it. So each word is matched half exactly in a forward automaton and half exactly, from its
end, in a backward one, and completed with one error (``automata.Automaton``); what both find is kept once.

The vocabulary is dealt by halves: a word of length m can be found by words of m - 1, m and m + 1 code
points, so it enters under its prefixes of half those lengths (two different ones at most), and its suffixes
likewise; a word asks under its own half. Halves are hashed to groups of about ``group`` words, an automaton
each. A half with more words than that is dealt over several automata which all of its words ask. A group
gives one row for each word that asks: how many it found and the most frequent one, never pairs.

Words that lead to others are followed by doubling: each round every word takes the root of its root.
Counts grow along a way at least by ``ratio``, so a way has at most as many steps as a count has digits.

Defined cases: null texts have no words, a null ``doc_id`` counts as an empty one where runs are changed by
checksum; null words and counts are ignored; a word that stands in several rows of ``variants``' input
counts with the sum of its rows; extra columns are ignored; empty tables give no rows; words of any length
and of any code points can be compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.automata import Automaton
from strophe.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Halves, with the digits of their length before them, that have groups of their own.
LONG = 20
#: Queries that go through an automaton at once.
BLOCK = 4096


def counted(docs: DataFrame, least: int = 7, often: int = 2, every: int | None = None) -> DataFrame:
    """(word, n): the runs of Latin letters of at least ``least`` code points that stand ``often`` times or more.

    ``every``: runs whose checksum with their doc_id it divides lose one code point first, a slip of the pen
    that is the same at every run of the job.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    # beyond ASCII only A-Z are lower-cased
    runs = runs.select("doc", F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run")).alias("run"))
    word = F.col("run")
    if every:
        h = F.crc32(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), "run"))
        at = h % F.length("run")
        cut = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", (at + 2).cast("int")))
        word = F.when(h % every == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _entries(words: DataFrame, back: bool) -> DataFrame:
    """(back, half, word, n, asks): a word under each half that may ask for it; ``asks`` at its own."""
    size = F.length("word")
    part = (lambda n: n - _half(n)) if back else _half
    own = part(size)
    other = F.array_distinct(F.array(own, part(size - 1), part(size + 1)))
    rows = words.select("word", "n", own.alias("own"), F.explode(F.filter(other, lambda x: x <= F.length("word"))).alias("h"))
    text = F.reverse("word") if back else F.col("word")
    return rows.select(F.lit(back).alias("back"), F.concat_ws(":", F.col("h").cast("string"), F.substr(text, F.lit(1), F.col("h"))).alias("half"), "word", "n", (F.col("h") == F.col("own")).alias("asks"))


def _dealt(entries: DataFrame, groups: int, group: int) -> DataFrame:
    """(back, part, word, n, asks, listed): entries in groups of about ``group`` words."""
    sizes = entries.groupBy("back", "half").agg(F.count("*").alias("_size")).filter(F.col("_size") > group)
    many = entries.join(sizes, ["back", "half"], "left").withColumn("_parts", F.coalesce(F.ceil(F.col("_size") / group), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    to = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(mine))
    each = many.withColumn("_mine", mine).withColumn("_to", F.explode(to))
    # a half of its own groups lies beyond the shared ones; long halves too, so that a group's words are of like length
    part = F.when((F.col("_parts") > 1) | (F.length("half") > LONG), F.xxhash64("half", "_to").bitwiseOR(F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("half"), F.lit(groups)))
    return each.select("back", part.alias("part"), "word", "n", "asks", (F.col("_to") == F.col("_mine")).alias("listed"))


def _codes(words: np.ndarray, alphabet: np.ndarray, back: bool) -> np.ndarray:
    """Rows of symbols: the ranks of the code points from 1, filled with 0."""
    points = words.view(np.uint32).reshape(len(words), -1)
    codes = np.where(points > 0, np.searchsorted(alphabet, points) + 1, 0)
    if back:
        lengths = (codes > 0).sum(1)
        at = lengths[:, None] - 1 - np.arange(codes.shape[1])
        codes = np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), 1), 0)
    return codes


def _neighbours(b: pd.DataFrame) -> pd.DataFrame:
    """For each word of a group that asks: near words found here, and the most frequent of them."""
    back = bool(b["back"].iat[0])
    listed = b[b["listed"]].drop_duplicates("word")
    asking = b[b["asks"]].drop_duplicates("word")
    if listed.empty or asking.empty:
        return pd.DataFrame({"word": asking["word"], "n": asking["n"], "near": 0, "best_n": pd.array([pd.NA] * len(asking), "Int64"), "best": None})
    width = max(1, int(b["word"].str.len().max()))
    held, asked = (np.array(x["word"].tolist(), f"<U{width}") for x in (listed, asking))
    alphabet = np.unique(np.concatenate([held, asked]).view(np.uint32))
    alphabet = alphabet[alphabet > 0]
    codes = _codes(held, alphabet, back)
    order = np.lexsort(codes.T[::-1])
    codes, held, n = codes[order], held[order], listed["n"].to_numpy(np.int64)[order]
    automaton = Automaton(codes, len(alphabet) + 2)
    # ranks by count, then in code-point order, name the best of a word's finds
    rank = np.empty(len(held), np.int64)
    rank[np.lexsort((held, -n))] = np.arange(len(held))
    by_rank = np.argsort(rank)
    best, near = np.full(len(asked), len(held)), np.zeros(len(asked), np.int64)
    for a in range(0, len(asked), BLOCK):
        own = _codes(asked[a : a + BLOCK], alphabet, back)
        lengths = (own > 0).sum(1)
        half = lengths // 2
        q, found = automaton.near(own, lengths, lengths - half if back else half)
        if back:  # words that also agree in the first half are the forward automaton's
            there = codes[found]
            size = (there > 0).sum(1)
            agree = size >= half[q]
            for k in range(int(half.max(initial=0))):
                on = (k < half[q]) & agree
                agree[on] &= there[on, size[on] - 1 - k] == own[q[on], lengths[q[on]] - 1 - k]
            q, found = q[~agree], found[~agree]
        near[a : a + BLOCK] = np.bincount(q, minlength=len(own))
        np.minimum.at(best, q + a, rank[found])
    some = best < len(held)
    at = by_rank[np.minimum(best, len(held) - 1)]
    word = pd.Series(held[at], dtype=object).where(some, None)
    count = pd.array(n[at], dtype="Int64")
    count[~some] = pd.NA
    return pd.DataFrame({"word": asking["word"].to_numpy(), "n": asking["n"].to_numpy(), "near": near, "best_n": count, "best": word})


def near_words(words: DataFrame, group: int = 8192) -> DataFrame:
    """(word, n, n_near, best, best_n): how many words are one edit away, and the one with the largest count
    (ties: the smaller in code-point order); a row for each different word."""
    words = materialize(words.filter("word is not null and n is not null").groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n")), "words")
    groups = max(1, -(-2 * words.count() // group))
    entries = _entries(words, False).unionByName(_entries(words, True))
    found = _dealt(entries, groups, group).groupBy("back", "part").applyInPandas(_neighbours, "word string, n long, near long, best_n long, best string")
    top = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), "best")))
    merged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), top.alias("top"))
    return merged.select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.k")).alias("best_n"))


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of (word, form) ways without circles: the last word of each way, by doubling."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        after = materialize(after, "roots")
        now = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return now
    raise RuntimeError(f"roots: not settled after {rounds} rounds")


def variants(words: DataFrame, ratio: int = 10, group: int = 8192) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) rows.

    ``form`` is the near word with the largest count if that is at least ``ratio`` times the word's own;
    ``root`` the last word that forms lead to, the word itself without one.
    """
    near = materialize(near_words(words, group), "near-words")
    led = F.col("best_n") >= ratio * F.col("n")
    rows = near.select("word", "n", "n_near", F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n"))
    last = roots(rows.filter("form is not null"))
    joined = rows.join(last, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
