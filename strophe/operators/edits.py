"""A fuzzy vocabulary index: terms by what is left of their beginning when letters are taken out.

Two terms at most ``edits`` apart share a remainder of their first ``PREFIX`` letters after taking out at
most ``edits`` letters of each: an insertion, deletion or replacement inside of the beginnings costs each at
most one letter. So terms are joined by the hashes of these remainders and verified by their distance. A
term has at most 29 remainders for two edits, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 7


def _without_one(s: Column) -> Column:
    """All strings that ``s`` becomes when one letter is taken out."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    return F.array_distinct(cut)


def remainders(term: Column, edits: int) -> Column:
    """Hashes of the first letters of ``term`` without up to ``edits`` of them."""
    level = F.array(F.substr(term, F.lit(1), F.lit(PREFIX)))
    every = level
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        every = F.concat(every, level)
    return F.array_distinct(F.transform(every, lambda s: F.xxhash64(s)))


def neighbourhoods(vocabulary: DataFrame, edits: int = 2) -> DataFrame:
    """(key, term) of the (term) rows."""
    return vocabulary.select(F.explode(remainders(F.col("term"), edits)).alias("key"), "term")


def within(term: Column, word: Column, edits: int, transposed: bool = False) -> Column:
    """Whether ``term`` is at most ``edits`` from ``word``; ``transposed`` counts two swapped letters as one edit."""
    near = (F.abs(F.length(term) - F.length(word)) <= edits) & F.levenshtein(term, word, edits).between(0, edits)
    if transposed and edits:
        near = near | F.exists(swapped(word), lambda s: F.levenshtein(term, s, edits - 1).between(0, edits - 1))
    return near


def swapped(word: Column) -> Column:
    """``word`` with each two neighbouring letters swapped."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: i < F.length(word))
    pick = lambda a, n=1: F.substr(word, a, F.lit(n))
    return F.array_distinct(F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), pick(i + 1), pick(i), F.substr(word, i + 2))))


def keys_of(words: DataFrame, edits: int, transposed: bool = False) -> DataFrame:
    """(word, key): what to look up for each of the (word) rows."""
    forms = F.concat(F.array("word"), swapped(F.col("word"))) if transposed else F.array("word")
    each = words.select("word", F.explode(forms).alias("form"))
    return each.select("word", F.explode(remainders(F.col("form"), edits)).alias("key")).distinct()


def near_terms(index: DataFrame, keys: DataFrame, edits: int, transposed: bool = False) -> DataFrame:
    """(word, term): the terms of the index at most ``edits`` from each word of ``keys``."""
    met = index.join(keys, "key").select("word", "term")
    return met.filter(within(F.col("term"), F.col("word"), edits, transposed)).distinct()
