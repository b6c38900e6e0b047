"""The stages one by one against plain versions of themselves, and together."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_decontam_slots import _leaks
from test_near import brute
from test_spans import PERSONAL, spans
from tokenizers import Tokenizer

from strophe.llm import boosting, queries

DATA = "/root/testdata/sf0.001"


def walk(forest, x):
    """The score of one row by one walk a tree."""
    total = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def redacted(text):
    """Fixed forms by start, then by end; one that begins inside another goes with it."""
    out, at = "", 0
    found = [x.split(":") for x in spans(text, PERSONAL).split(",") if x]
    for a, z, kind in sorted((int(a), int(z), kind) for kind, a, z in found):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, z)
    return out + text[at:]


def test_stages_are_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "sequences"]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    forest = boosting.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    at, got = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DATA)
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        got.append({r["doc_id"]: r["text"] for r in at.collect()})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i: t for i, t in texts.items() if walk(forest, boosting.statistics(t)) >= 0.5}
    assert got[0] == good  # of so few rows the classifier learns to keep all
    roots = set(brute(list(good.items())).values())
    assert got[1] == {i: good[i] for i in roots} and len(roots) < len(good)
    clean = {i: t for i, t in got[1].items() if not any(_leaks(t or "", x or "") for x in items)}
    assert got[2] == clean and len(clean) < len(got[1])
    assert got[3] == {i: t and redacted(t) for i, t in clean.items()} and got[3] != clean
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_VOCABULARY))
    library.encode_special_tokens = True
    want = {}
    for i, t in got[3].items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k): (len(own), zlib.crc32(own.tobytes())) for k, own in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in packed.itertuples()} == want
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 4096 and g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]


def test_stages_edges(spark):
    """Null and empty texts, repeated rows and an empty table: what each stage keeps of them."""
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "mail a@b.cd now", "en", "s", 5), (3, "mail a@b.cd now", "en", "s", 5)]
    keys = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    every = sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    docs = spark.createDataFrame(rows, schema)
    by = dict(corpus_pipeline.STAGES)
    scored = boosting.score(docs, boosting.train(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    assert by["quality"](spark, docs, DATA).count() == scored.filter("score >= 0.5").count()
    # blank texts are copies of each other; a row without an id takes no part
    assert keys(by["near_duplicates"](spark, docs, DATA)) == [(False, 1, ""), (False, 3, "mail a@b.cd now"), (True, 0, "mail a@b.cd now")]
    assert keys(by["decontamination"](spark, docs, DATA)) == every
    assert keys(by["personal_data"](spark, docs, DATA)) == [(a, i, t.replace("a@b.cd", "[EMAIL]")) for a, i, t in every]
    assert by["sequences"](spark, docs, DATA).agg(F.sum("length")).first()[0] > 0 and by["sequences"](spark, docs, DATA).count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_registered():
    assert len(queries.QUERIES) == 10 and all(n.startswith("op") for n in queries.QUERIES)


def test_quality_stage_drops_rows(spark):
    """On a table with enough labels the stage keeps what a plain walk scores 0.5 or more, and drops the rest."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    forest = boosting.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, data).select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert kept == {i for i, t in texts.items() if walk(forest, boosting.statistics(t)) >= 0.5}
    assert 0 < len(kept) < len(texts)
