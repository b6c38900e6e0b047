"""Quality and toxicity: held-out accuracy, the arrays against a plain walk, edges."""

import zlib

import numpy as np
import pytest

from strophe.llm import boosting, ordinal

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, y int, score int"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    good = label == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "column", "least"), [(boosting, "quality", "score", 0.9), (ordinal, "toxic", "expected_severity", 0.9)])
def test_held_out(tables, module, label, column, least):
    docs, labels = tables
    got = module.score(docs, module.train(docs, labels)).join(labels.select("doc_id", labels[label].alias("mark")), "doc_id").toPandas()
    held = got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)
    if "held_out" in got:
        assert (got["held_out"] == held).all()
    assert auc(got[held][column].to_numpy(), got[held]["mark"].to_numpy()) > least


def test_grades_are_filled_and_predicted(tables):
    """Each derived grade holds a like share of the toxic texts, each is predicted, and severity follows the density."""
    docs, labels = tables
    model = ordinal.train(docs, labels)
    assert len(model.filled) == 4 and min(model.filled[1:]) > 0.2 * sum(model.filled[1:])
    got = ordinal.score(docs, model).toPandas()
    assert set(got["grade"]) == {0, 1, 2, 3} and ((got["grade"] > 0) == (got["toxic"] == 1)).all()
    mean = got.groupby("grade")["expected_severity"].mean()
    assert (np.diff(mean) > 0).all()


def test_graded():
    toxic, density = np.array([0, 1, 1, 1, 1, 1, 1], bool), np.array([9, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    assert ordinal.graded(toxic, density, 4).tolist() == [0, 1, 1, 2, 2, 3, 3]
    assert ordinal.graded(toxic[:2], density[:2], 4).tolist() == [0, 1] and ordinal.graded(toxic[:0], density[:0], 4).tolist() == []


def test_labels_of_the_held_out_fold_are_not_read(tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    lied = labels.withColumn("quality", F.when(boosting.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = boosting.train(docs, labels, train_rows=500), boosting.train(docs, lied, train_rows=500)
    assert (a.value == b.value).all() and (a.threshold == b.threshold).all()


def test_forest_is_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    f = boosting.fit(x, y, trees=12, depth=3)
    for i in range(0, 400, 17):
        total = f.base
        for t in range(len(f.feature)):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + (2 if x[i, f.feature[t, node]] > f.threshold[t, node] else 1)
            total += f.value[t, node - f.feature.shape[1]]
        assert abs(total - f.margin(x[i : i + 1])[0]) < 1e-9
    assert ((f.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 300)
    rows = [{int(k): 1 for k in range(g)} | {3 + int(rng.integers(0, 5)): 1} for g in grade]
    w, theta = ordinal.fit(rows, grade, 8, 4)
    assert (np.diff(theta) > 0).all() and (w[:3] > 0).all()
    model = ordinal.Model({}, w, theta)
    severity = [model.above(np.array([sum(w[k] * np.log(2) for k in r)])).sum() for r in rows]
    assert auc(np.array(severity), (grade > 1).astype(int)) > 0.99


@pytest.mark.parametrize(("module", "label"), [(boosting, "quality"), (ordinal, "toxic")])
def test_model_edges(spark, module, label):
    rows = [(1, None, None, None, 1, 1), (2, "", "en", "s", 1, 1), (None, "some words here", "en", "s", 1, 1), (3, "word " * 200_000, "en", "s", 1, 1), (3, "other", "en", "s", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for labels in ([], [(1, 1)], [(1, None), (None, 1), (2, 0), (2, 0), (3, 1)]):
        own = spark.createDataFrame([(d, q, 7) for d, q in labels], f"doc_id long, {label} int, text int")
        model = module.train(docs, own)
        out = module.score(docs, model)
        assert out.count() == 5
        assert module.score(docs.limit(0), model).count() == 0
        first = out.columns[1] if module is ordinal else "score"
        assert all(np.isfinite(r[first]) for r in out.collect())


def test_repeated_rows_stay_bounded(spark):
    """A labelled id on very many rows is one row of the fit."""
    one, other = [k for k in range(9) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    docs = spark.range(30_000).selectExpr(f"{one}L AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(other, "other words")], "doc_id long, text string"))
    labels = spark.createDataFrame([(one, 1), (other, 0)], "doc_id long, toxic int")
    assert sum(ordinal.train(docs, labels).filled) == 2


def test_keep(spark, tables):
    docs, labels = tables
    model = boosting.train(docs, labels)
    kept = boosting.keep(docs, model)
    scored = boosting.score(docs, model).filter("score >= 0.5").count()
    assert kept.columns == docs.columns and kept.count() == scored
