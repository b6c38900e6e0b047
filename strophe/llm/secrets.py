"""Secrets in text: fixed forms, and runs of characters that pass as random.

Every run of 20 or more characters of an encoding's alphabet goes through a battery of tests against
the uniform distribution over the alphabet of its inferred encoding: chi-squared for the counts, the
runs test above and below the middle value, and lag-one serial correlation. Fisher's method combines
the three into one p-value; ordinary words, numbers and paths get values near zero, random keys spread
evenly over 0..1.

A run is reported if its p-value reaches the threshold of its length class. The threshold follows from
all runs of that class in the corpus: those above one half are taken for half of the random ones, which
tells how many of the runs above a threshold are not random; the lowest threshold at which that share
is at most ``fdr`` is used, none if there is no such threshold. Short runs, where the tests are weak and
ordinary ones slip through, thus need a higher value.

Column expressions only; the thresholds are a few hundred counts.

Defined cases: a null text is empty and has no span; texts and runs of any length are tested whole; rows with a null doc_id and repeated rows are
scanned like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialize
from strophe.llm.spans import count, covers, find, let, listed, meets, sha256

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
DECIMAL, HEXADECIMAL = "0123456789", "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64 = ALNUM + "+/-_"
#: Upper ends of the length classes.
CLASSES = (24, 32, 40, 48, 64, 96, 128)
BINS = 40


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic approximation good to 2e-4."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z))


def _alphabet(token: Column) -> Column:
    """(alphabet, token in that alphabet's letters) of the narrowest encoding that fits."""
    bare = F.regexp_replace(token, "=+$", "")
    kinds = ((r"^[0-9]+$", DECIMAL, bare), (r"^(?:[0-9a-f]+|[0-9A-F]+)$", HEXADECIMAL, F.lower(bare)), (r"^[A-Z2-7]+$", BASE32, bare), (r"^[A-Za-z0-9]+$", ALNUM, bare))
    out = F.struct(F.lit(BASE64).alias("letters"), bare.alias("text"), F.lit(64).alias("k"))
    for pattern, letters, text in reversed(kinds):
        out = F.when(bare.rlike(pattern), F.struct(F.lit(letters).alias("letters"), text.alias("text"), F.lit(len(letters)).alias("k"))).otherwise(out)
    return out


def randomness(token: Column) -> Column:
    """The battery's combined p-value under a uniform random source of the inferred encoding."""

    def let(value: Column, body) -> Column:  # a value used many times is worked out once
        return F.element_at(F.transform(F.array(value), body), 1)

    def tests(s: Column) -> Column:
        n, k, v, high, mean = s["n"], s["k"], s["v"], s["high"], s["mean"]
        square = F.aggregate(F.transform(F.array_distinct(v), lambda c: F.pow(F.size(F.filter(v, lambda x: x == c)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda x, y: x + y)
        chi2, df = square * k / n - n, k - 1
        z_chi = (F.pow(F.greatest(chi2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
        ones = F.aggregate(high, F.lit(0.0), lambda x, y: x + y)
        zeros = n - ones
        changes = F.aggregate(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: x + y)
        mean_runs = F.lit(2.0) * ones * zeros / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when((ones == 0) | (zeros == 0) | (var_runs <= 0), F.lit(8.0)).otherwise(F.abs(changes + 1 - mean_runs) / F.sqrt(F.greatest(var_runs, F.lit(1e-9))))
        spread = F.aggregate(v, F.lit(0.0), lambda x, y: x + (y - mean) * (y - mean))
        lag = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda x, y: x + y)
        z_serial = F.when(spread <= 0, F.lit(8.0)).otherwise(F.abs(lag / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))
        logs = -(F.log(_normal_tail(z_chi)) + F.log(F.least(2 * _normal_tail(z_runs), F.lit(1.0))) + F.log(F.least(2 * _normal_tail(z_serial), F.lit(1.0))))
        return F.exp(-logs) * (1 + logs + logs * logs / 2)  # Fisher: chi-squared with six degrees of freedom

    def measured(s: Column) -> Column:
        """With what the tests use for every letter: a lambda would work it out again each time."""
        high = F.transform(s["v"], lambda x: F.when(x * 2 >= s["k"], 1.0).otherwise(0.0))
        mean = F.aggregate(s["v"], F.lit(0.0), lambda x, y: x + y) / s["n"]
        return F.struct(s["n"].alias("n"), s["k"].alias("k"), s["v"].alias("v"), high.alias("high"), mean.alias("mean"))

    places = lambda a: F.transform(F.split(a["text"], ""), lambda c: (F.instr(a["letters"], c) - 1).cast("double"))
    return let(_alphabet(token), lambda a: F.when(F.length(a["text"]) < 2, F.lit(0.0)).otherwise(let(F.struct(F.length(a["text"]).cast("double").alias("n"), a["k"].cast("double").alias("k"), places(a).alias("v")), lambda s: let(measured(s), tests))))


def length_class(token: Column) -> Column:
    out = F.lit(len(CLASSES))
    for k, most in reversed(list(enumerate(CLASSES))):
        out = F.when(F.length(token) <= most, F.lit(k)).otherwise(out)
    return out


def thresholds(counts: list, fdr: float = 0.05) -> dict[int, float]:
    """{length class: least p-value} from rows (class, bin, n) of all runs."""
    out = {}
    by: dict[int, list[int]] = {}
    for r in counts:
        by.setdefault(r["class"], [0] * BINS)[min(BINS - 1, r["bin"])] += r["n"]
    for c, n in by.items():
        random = 2 * sum(n[BINS // 2 :])
        above = 0
        for b in range(BINS - 1, -1, -1):
            above += n[b]
            if b and above and 1 - random * (1 - b / BINS) / above <= fdr:
                out[c] = b / BINS
    return out


def scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """(doc_id, base, added, runs): the spans of every row of ``docs``.

    ``runs``: every tested run (start, end, p, random), also those that overlap a fixed form; ``random`` is
    the battery's verdict, ``added`` are the random ones that no fixed form covers.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    assign = F.filter(find(F.col("text"), ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    base = F.concat(assign, find(F.col("text"), ACCESS, "access"), find(F.col("text"), HEX, "hex"))
    runs = rows.select("doc_id", base.alias("base"), find(F.col("text"), RUN, "random").alias("runs"))
    scored = F.transform("runs", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), length_class(s["match"]).alias("class"), randomness(s["match"]).alias("p")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = materialize(runs.select("doc_id", plain.alias("base"), scored.alias("runs")), "secret-runs")
    one = found.select(F.explode("runs").alias("r")).select("r.class", F.floor(F.col("r.p") * BINS).cast("int").alias("bin"))
    least = thresholds(one.groupBy("class", "bin").agg(F.count("*").alias("n")).collect(), fdr)  # classes x bins rows at most
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else None
    random = lambda s: F.coalesce(s["p"] >= F.try_element_at(bound, s["class"]), F.lit(False)) if least else F.lit(False)
    tested = F.transform("runs", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p"), random(s).alias("random")))
    tried = found.select("doc_id", "base", tested.alias("runs"))
    return tried.select("doc_id", "base", let(covers(F.col("base")), lambda held: F.filter("runs", lambda s: s["random"] & ~meets(held, s))).alias("added"), "runs")


def digest(found: DataFrame) -> DataFrame:
    every = F.concat("base", F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [count(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    random = F.filter("runs", lambda s: s["random"])
    shown = F.transform("runs", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["p"], 4), F.when(s["random"], "random").otherwise("plain")))
    return found.select(
        "doc_id", *counts, sha256(listed(F.col("base"), BASE)).alias("base_sha256"), listed(every, KINDS).alias("spans"),
        F.size("runs").cast("long").alias("n_runs"), F.size(random).cast("long").alias("n_random"), F.array_join(shown, ",").alias("verdicts"),
    )
