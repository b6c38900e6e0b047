"""Personal data: fixed forms, and candidates chosen by boosted trees.

High-recall generators propose overlapping candidates: the fixed forms themselves, telephone numbers in
local form, disguised addresses, account numbers. Boosted trees score a candidate from its format
(digits, separators, length, generator) and its context (what stands just before and after); they are
evaluated as one Column expression.

Labels need no annotation. They come from evidence that is not a feature, and candidates without any are
not learned from:

* fixed forms: their own check (Luhn, number ranges, digit counts);
* local numbers: part of a valid international number, or behind a word for telephones, against part of
  a valid address or card, a calendar date, a number behind a word for versions, orders or ids;
* disguised addresses: an ending that valid addresses of the corpus have, against any other;
* account numbers: the check digits modulo 97.

For each generator the threshold is calibrated on all its labelled candidates in different texts, at
their full counts: the lowest margin at which the share of positives above it reaches ``precision``, both
among all of them and among the half of the texts that the fit does not see, which must have at least
``least_seen`` positives there; a generator without such a threshold adds nothing. Of overlapping
proposals the one with the largest excess over its threshold is taken first, and none that overlaps a
fixed form; fixed forms that pass their check always stay.

Column expressions only on the executors; what comes to the driver is at most ``train_rows`` distinct
feature vectors, the most frequent, for the fit alone, and the counts by margin in steps of 1 / ``STEPS``.

Defined cases: a null text is empty and has no span; texts of any length are scanned whole; rows with a
null doc_id and repeated rows are scanned like any other; extra columns are ignored (``redact`` keeps
them); an empty table gives an empty result; without candidates of both labels no span is added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.boosting import Forest, fit
from strophe.llm.common import materialize
from strophe.llm.spans import SPAN, count, covers, find, let, listed, meets, overlaps, sha256

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone_local", "email_disguised", "account")
KINDS = (*BASE, *ADDED)
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    # a match starts where its run starts, or where the match before it ended
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,5}){1,3}(?![0-9A-Za-z.-])",
    "email_disguised": rf"(?i)(?<![{LOCAL}])[{LOCAL}]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{{2,}}+",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
FEATURES = ("generator", "length", "digits", "separators", "letters", "groups", "first", "before_space", "before_mark", "after_space", "after_mark", "near_at")
#: What a text must hold for a pattern to be tried.
HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "phone_local": r"[0-9]\)?[\x20.-][0-9]{2}",
    "email_disguised": r"(?i)dot[\])\x20]", "account": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
}
CALLED, NUMBERED = r"(?i)(?:tel|phone|call|mobile|fax)\W*\z", r"(?i)(?:\bv|version|release|order|\bid|\bno|\bnr|isbn|#)\W*\z"
DATE = r"^(?:(?:19|20)[0-9]{2}[\x20.-](?:0[1-9]|1[0-2])[\x20.-](?:[0-2][0-9]|3[01])|(?:[0-2][0-9]|3[01])[\x20.-](?:[0-2][0-9]|3[01])[\x20.-](?:(?:19|20)[0-9]{2}|[0-9]{2}))$"

#: Steps of a margin of 1, for thresholds. Powers of two, so that a step is an exact margin.
STEPS = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(s: Column) -> Column:
    """Whether a match of a fixed form passes the form's own check."""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
    n = F.length(_digits(s["match"]))
    card = F.when(n.between(12, 19), _luhn(_digits(s["match"]))).otherwise(False)
    return (
        F.when(s["kind"] == "email", True)
        .when(s["kind"] == "ip", s["match"].rlike(rf"^{part}\.{part}\.{part}\.{part}\z"))
        .when(s["kind"] == "card", card)
        .when(s["kind"] == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _checked_account(match: Column) -> Column:
    """Whether the number with its first four letters behind and letters as 10 to 35 leaves 1 modulo 97."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    digits = F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4))), ""), lambda c: c != "")
    step = lambda a, c: F.when(c < "A", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(digits, F.lit(0), step) == 1


def evidence(s: Column, base: Column) -> Column:
    """1 or 0 where something but the features tells what a candidate is, else null; endings come later.

    ``base``: the valid fixed forms as ``covers`` gives them.
    """
    part_of = lambda *kinds: meets(base, s, lambda o: o["kind"].isin(*kinds))
    local = F.when(part_of("phone"), 1).when(part_of("ip", "card"), 0).when(s["match"].rlike(DATE), 0).when(s["before"].rlike(CALLED), 1).when(s["before"].rlike(NUMBERED), 0)
    return F.when(s["kind"] == "phone_local", local).when(s["kind"] == "account", _checked_account(s["match"]).cast("int")).when(s["kind"].isin("ip", "card", "phone"), passes(s).cast("int"))


def described(s: Column) -> Column:
    """The features of a candidate, small whole numbers in the order of ``FEATURES``."""
    m, before, after = s["match"], s["before"], s["after"]
    capped = lambda c, most: F.least(c, F.lit(most)).cast("int")
    generator = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0))
    values = (
        generator, capped(F.length(m), 40), capped(F.length(_digits(m)), 24), capped(F.length(F.regexp_replace(m, r"[^\x20().-]", "")), 8),
        capped(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), 20), capped(F.size(F.split(m, "[^0-9]+")), 8), F.when(m.rlike(r"^[+(]"), 1).otherwise(0),
        F.when(before.rlike(r"\s\z"), 1).when(before == "", 2).otherwise(0), F.when(before.rlike(r"[:=(\[<][\s]*\z"), 1).otherwise(0),
        F.when(after.rlike(r"^\s"), 1).when(after == "", 2).otherwise(0), F.when(after.rlike(r"^[.,;:!?)]"), 1).otherwise(0), F.when(F.concat(before, after).contains("@"), 1).otherwise(0),
    )
    return F.array(*[v.cast("int") for v in values])


def margin(features: Column, forest: Forest) -> Column:
    """The sum of the trees over an array of features, as nested conditions."""
    total = F.lit(float(forest.base))
    inner = forest.feature.shape[1] if len(forest.feature) else 0

    def tree(t: int, node: int) -> Column:
        if node >= inner:
            return F.lit(float(forest.value[t, node - inner]))
        cut = forest.threshold[t, node]
        if not np.isfinite(cut):
            return tree(t, 2 * node + 1)
        at = F.get(features, F.lit(int(forest.feature[t, node])))
        return F.when(at > float(cut), tree(t, 2 * node + 2)).otherwise(tree(t, 2 * node + 1))

    for t in range(len(forest.feature)):
        total = total + tree(t, 0)
    return total


def candidates(text: Column) -> Column:
    """Every proposal; a pattern is tried on the texts that hold its hint."""
    none = F.array().cast(SPAN)
    hint = lambda kind: text.contains("@") if HINTS[kind] == "@" else text.rlike(HINTS[kind])
    return F.concat(*[F.when(hint(kind), find(text, pattern, kind, context=16)).otherwise(none) for kind, pattern in PATTERNS.items()])


def _labelled(found: DataFrame) -> DataFrame:
    """(kind, features, y, n, n_held): labelled candidates over different texts, all of them.

    ``n_held`` counts those in the half of the texts that the fit does not see.
    """
    one = found.filter(F.size("spans") > 0).dropDuplicates(["tkey"]).select("tkey", F.explode("spans").alias("s"))
    held = F.pmod(F.xxhash64("tkey"), F.lit(2)) == 1
    some = one.select("s.kind", "s.features", "s.y", "s.ending", held.alias("held"))
    plain = some.filter("kind != 'email_disguised'").select("kind", "features", "y", "held")
    # disguised addresses by ending; valid addresses first tell each ending once, so the join adds no rows
    known = materialize(some.filter("kind = 'email'").select(F.col("ending").alias("_ending"), F.lit(1).alias("_known")).distinct(), "endings")
    guessed = some.filter("kind = 'email_disguised'").groupBy("kind", "features", "ending", "held").agg(F.count("*").alias("n"))
    told = guessed.join(known, guessed["ending"] == known["_ending"], "left").filter(F.lit(known.limit(1).count() > 0))
    told = told.select("kind", "features", F.coalesce("_known", F.lit(0)).alias("y"), "held", "n")
    counted = plain.filter("y IS NOT NULL").groupBy("kind", "features", "y", "held").agg(F.count("*").alias("n")).unionByName(told)
    return counted.groupBy("kind", "features", "y").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("n_held"))


def train(found: DataFrame, train_rows: int = 20_000, precision: float = 0.95, least_seen: int = 5, trees: int = 12, depth: int = 3) -> tuple[Forest, dict[str, float]]:
    """(trees, least margin of each added kind) from the labelled candidates."""
    seen = materialize(_labelled(found), "vectors")
    n_fit = F.col("n") - F.col("n_held")
    rows = seen.filter(n_fit > 0).orderBy(F.desc(n_fit), "kind", "features", "y").limit(train_rows).select("features", "y", n_fit.alias("n")).collect()
    none = Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), -30.0)
    if len({r["y"] for r in rows}) < 2:
        return none, {}
    x = np.array([r["features"] for r in rows], float)
    y = np.array([r["y"] for r in rows], float)
    total: dict[tuple, int] = {}
    for r in rows:
        total[tuple(r["features"])] = total.get(tuple(r["features"]), 0) + r["n"]
    # in the fit a frequent vector must not outvote the rest; its two labels keep their shares
    w = np.array([max(1, round(r["n"] * min(1, 64 / total[tuple(r["features"])]))) for r in rows])
    forest = fit(np.repeat(x, w, 0), np.repeat(y, w), trees=trees, depth=depth, rate=0.3)
    step = F.floor(margin(F.col("features"), forest) * STEPS).alias("step")
    sums = [F.sum(c * y).alias(f"{name}{label}") for name, c in (("n", F.col("n")), ("held", F.col("n_held"))) for label, y in (("", F.lit(1)), ("_good", F.col("y")))]
    steps = seen.filter(F.col("kind").isin(*ADDED)).select("kind", step, "n", "n_held", "y").groupBy("kind", "step").agg(*sums).collect()  # some thousands at most
    least = {}
    for kind in ADDED:
        own = sorted(((r["step"], r["n"], r["n_good"], r["held"], r["held_good"]) for r in steps if r["kind"] == kind), reverse=True)
        above = np.cumsum(np.array([r[1:] for r in own], np.int64).reshape(-1, 4), 0)
        for cut, (all_n, all_good, held_n, held_good) in zip(own, above.tolist(), strict=True):
            if held_good >= least_seen and all_good >= precision * all_n and held_good >= precision * held_n:
                least[kind] = cut[0] / STEPS  # the last one is the lowest
    return forest, least


def _bare(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))


def judged(text: Column) -> Column:
    """The candidates of a text: the verdict of the form's own check, features, evidence and ending."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ending = lambda s: F.when(s["kind"].startswith("email"), F.lower(F.regexp_extract(s["match"], r"([A-Za-z0-9-]+)\z", 1)))

    def one(s: Column, base: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), passes(s).alias("valid"), described(s).alias("features"), evidence(s, base).alias("y"), ending(s).alias("ending"))

    return let(candidates(text), lambda every: let(covers(F.filter(every, passes)), lambda base: F.transform(every, lambda s: one(s, base))))


def chosen(spans: Column, forest: Forest, least: dict[str, float]) -> tuple[Column, Column]:
    """(fixed forms, added ones) among judged candidates: greedy by the excess over the threshold."""
    base = F.transform(F.filter(spans, lambda s: s["valid"]), _bare)
    none = F.transform(F.filter(spans, lambda s: F.lit(False)), _bare)
    if not least:
        return base, none
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    over = lambda s: F.when(s["kind"].isin(*least), margin(s["features"], forest) - bound[s["kind"]])
    good = let(covers(base), lambda held: F.filter(spans, lambda s: F.when(s["kind"].isin(*least), (over(s) >= 0) & ~meets(held, s)).otherwise(False)))

    def taken(good: Column) -> Column:
        """Proposals that meet no other one, and of the others those with the largest excess first."""
        same = lambda s, o: (s["start"] == o["start"]) & (s["end"] == o["end"]) & (s["kind"] == o["kind"])
        torn = let(covers(good), lambda held: F.filter(good, lambda s: meets(held, s, lambda o: ~same(s, o))))
        alone = let(covers(good), lambda held: F.filter(good, lambda s: ~meets(held, s, lambda o: ~same(s, o))))
        ranked = F.array_sort(F.transform(torn, lambda s: F.struct((-over(s)).alias("excess"), *[s[c].alias(c) for c in ("start", "end", "kind")])))
        take = lambda kept, s: F.when(overlaps(kept, s), kept).otherwise(F.concat(kept, F.array(_bare(s))))
        return F.concat(F.transform(alone, _bare), F.aggregate(ranked, none, take))

    return base, F.when(F.size(spans) > 0, let(good, lambda g: F.when(F.size(g) > 0, taken(g)).otherwise(none))).otherwise(none)


def scan(docs: DataFrame, train_rows: int = 20_000, precision: float = 0.95) -> DataFrame:
    """(doc_id, base, added) of every row; arrays of spans (start, end, kind)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), judged(F.col("text")).alias("spans"))
    found = materialize(found, "candidates")
    base, added = chosen(F.col("spans"), *train(found, train_rows, precision))
    return found.select("doc_id", base.alias("base"), added.alias("added"))


def redact(docs: DataFrame, train_rows: int = 20_000, precision: float = 0.95) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; ``n_chars`` follows the text."""
    found = materialize(docs.select(F.xxhash64("text").alias("tkey"), judged(F.col("text")).alias("spans")).filter(F.size("spans") > 0), "candidates")
    model = train(found, train_rows, precision)
    text = F.col("text").cast("string")

    def cover(spans: Column) -> Column:
        base, added = chosen(spans, *model)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            mark = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], mark)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        return F.aggregate(F.array_sort(F.concat(base, added)), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))

    clear = F.element_at(F.transform(F.array(judged(F.col("text"))), lambda spans: F.when(F.size(spans) > 0, cover(spans)).otherwise(text)), 1)
    out = docs.withColumn("text", F.when(text.isNotNull(), clear))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    counts = [count(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    every = F.concat("base", "added")
    return found.select("doc_id", *counts, sha256(listed(F.col("base"), BASE)).alias("base_sha256"), listed(every, KINDS).alias("spans"), F.size(every).cast("long").alias("n_spans"))
