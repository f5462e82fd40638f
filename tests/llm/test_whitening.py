"""Whitened embeddings against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacanta.llm import whitening
from vacanta.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors, k):
    x = np.floor(64 * np.array(vectors, "f4").astype("f8")).astype("i8") + 1_000_000
    n = len(x)
    apart = n * x - x.sum(0)
    e, v = np.linalg.eigh((apart / n).T @ (apart / n) / n)
    e, v = e[::-1], v[:, ::-1]
    return (apart / n) @ v[:, :k] / np.sqrt(e[:k]), e, (apart * apart).sum(1)


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], SCHEMA)


def matches(df, vectors, k):
    z, e, deviation = dense(vectors, k)
    rows = df.toPandas()
    assert len(rows) == len(vectors) * k
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * z).sum(0))
    assert np.abs(got * sign - z).max() < 1e-8
    assert (rows.groupby("vec_id").deviation.first().to_numpy() == deviation).all()
    assert np.allclose(rows.groupby("component").explained.first(), e[:k] / e.sum(), rtol=1e-10)
    assert (rows.n == len(vectors)).all() and rows.identity_error.max() < 1e-9 and rows.identity_error.nunique() == 1


@pytest.mark.parametrize("d, k", [(24, 4), (6, 32), (40, 8)])
def test_against_dense(spark, d, k):
    random = np.random.default_rng(d)
    vectors = random.standard_normal((300, d)) * np.linspace(3, 1, d) + random.standard_normal(d) * 50
    matches(whiten(table(spark, vectors).repartition(5), k, guard=4, degree=6), vectors, min(k, d))


def test_flat_spectrum_ends(spark):
    """Without a gap behind the wanted ones the block grows until it holds all dimensions."""
    vectors = np.random.default_rng(5).standard_normal((2000, 30))
    matches(whiten(table(spark, vectors), 4, guard=2, degree=3), vectors, 4)


def test_the_filter_is_used(spark, monkeypatch):
    calls = []
    original = whitening.filtered
    monkeypatch.setattr(whitening, "filtered", lambda *a: calls.append(a[1].shape) or original(*a))
    vectors = np.random.default_rng(3).standard_normal((400, 32)) * np.geomspace(10, 1, 32)
    matches(whiten(table(spark, vectors), 4, guard=4), vectors, 4)
    assert calls and all(shape[1] < 32 for shape in calls)


def test_unusable_vectors_are_dropped(spark):
    good = np.random.default_rng(1).standard_normal((50, 3)).astype("f4")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(good)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [1.0, float("inf"), 2.0]), (105, [1.0, 2.0])]
    matches(whiten(spark.createDataFrame(rows + bad, SCHEMA), 3), good, 3)


def test_repeated_rows_null_ids_and_other_columns(spark):
    good = np.random.default_rng(2).standard_normal((20, 3)).astype("f4")
    rows = [(None if i % 3 == 0 else 7, [float(c) for c in v]) for i, v in enumerate(good)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "c", "x", "component", "whitened", "n")})
    out = whiten(df, 2).toPandas()
    assert len(out) == 80 and out.vec_id.isna().sum() == 28 and (out.n == 40).all()
    assert out.identity_error.max() < 1e-9


def test_no_variance_and_no_rows(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA)).count() == 0
    one_direction = [(i, [float(i), 3.0]) for i in range(9)]
    assert whiten(spark.createDataFrame(one_direction, SCHEMA)).select("component").distinct().count() == 1
    huge = [(i, [1e30 * (-1) ** i, float(i)]) for i in range(9)]
    assert whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).count() > 0
