"""The quality model: held-out accuracy, and its parts against direct computation."""

import zlib

import numpy as np
import pytest

from vacanta.llm import quality_model as qm
from vacanta.llm.queries import QUERIES


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    d = f"/root/testdata/{sf}"
    got = QUERIES["op6_quality_model"](spark, d).toPandas()
    assert got.doc_id.is_unique and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    test = got[got.held_out].merge(labels, on="doc_id")
    one, zero = test.score[test.quality == 1].to_numpy(), test.score[test.quality == 0].to_numpy()
    area = (one[:, None] > zero[None]).mean() + (one[:, None] == zero[None]).mean() / 2
    assert area > 0.97 and (test.predicted == test.quality).mean() > 0.96
    assert test.predicted[test.quality == 1].mean() > 0.98


def test_labels_held_out_change_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.withColumn("quality", qm.F.when(qm.held_out(qm.F.col("doc_id")), 1 - qm.F.col("quality")).otherwise(qm.F.col("quality")))
    a, b = qm.fit_model(docs, labels), qm.fit_model(docs, flipped)
    assert all((p == q).all() for p, q in zip(a.mains, b.mains)) and a.intercept == b.intercept
    assert a.pairs.keys() == b.pairs.keys()


def test_tables_add_up_and_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = qm.fit_tables(x, y, rounds=20)
    assert (1, 0) in model.pairs
    score = model.score(x)
    assert ((score > 0.5) == y).mean() > 0.9
    for row in range(20):
        b = [int(np.sum(e <= v)) for e, v in zip(model.edges, x[row])]
        total = model.intercept + sum(t[k] for t, k in zip(model.mains, b))
        total += sum(t[b[i] // model.coarse, b[j] // model.coarse] for (i, j), t in model.pairs.items())
        assert score[row] == pytest.approx(1 / (1 + np.exp(-total)))


def test_cut_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(30):
        g, h = rng.normal(size=7), rng.random(7)
        gains = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) for k in range(1, 7)]
        assert qm.best_cut(g, h, 1.0)[1] == 1 + int(np.argmax(gains))


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (2, " \n ", 2), (3, "w " * 50000, 3), (4, "é#\x00", 4), (4, "é#\x00", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE int")
    labels = spark.createDataFrame([(3, 1), (4, None), (99, 0), (None, 1), (0, 0)], "doc_id long, quality int")
    model = qm.fit_model(df, labels)
    got = qm.score_documents(df, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    scored = {r.text: r.score for r in got.collect()}
    assert got.count() == 6 and scored[None] == scored[""] and all(0 <= s <= 1 for s in scored.values())
    none = qm.fit_model(df, labels.limit(0))
    assert {r.score for r in qm.score_documents(df, none).collect()} == {0.5}
    assert qm.score_documents(df.limit(0), model).count() == 0
