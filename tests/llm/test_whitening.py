"""Whitening against numpy's eigenvectors, exact figures against Python integers, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statekit.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(vectors):
    x = [[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in row] for row in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    away = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x])
    roots, axes = np.linalg.eigh(away.T @ away / n)
    return deviation, away, roots[::-1], axes[:, ::-1]


def held(spark, df, name="embedding"):
    model = whitening.fit(spark, df, name)
    error = whitening.identity_error(spark, df, model, name)
    return model, error, whitening.whiten(spark, df, model, name=name).toPandas()


def test_whole_table(spark):
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint"
    got = got.toPandas()
    source = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id")["embedding"]
    deviation, away, roots, axes = brute(source.tolist())
    assert len(got) == len(source) * 32 and got["identity_error"].max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[source.index].to_numpy()
    want = away @ axes[:, :32] / np.sqrt(roots[:32])
    turn = np.sign((wide * want).sum(axis=0))
    np.testing.assert_allclose(wide, want * turn, rtol=0, atol=1e-8)
    assert got.groupby("vec_id")["deviation"].first().loc[source.index].tolist() == deviation
    explained = got.groupby("component")["explained"].first().to_numpy()
    np.testing.assert_allclose(explained, roots[:32] / roots.sum(), rtol=1e-12)


def test_equal_roots_and_a_flat_direction(spark):
    """Two equal eigenvalues, one that differs in the last place only, and one of zero."""
    corners = [(s, 0, 0, 0, 1) for s in (-2, 2)] + [(0, s, 0, 0, 1) for s in (-2, 2)] + [(0, 0, s, 0, 1) for s in (-1, 1)]
    rows = corners * 20 + [(0, 0, 0, 3, 1), (0, 0, 0, -3, 1)]
    model, error, got = held(spark, table(spark, [(i, [float(x) for x in r]) for i, r in enumerate(rows)]))
    assert len(model.roots) == 4 and error < 1e-12 and model.roots[0] == model.roots[1]
    np.testing.assert_allclose(model.vectors.T @ model.vectors, np.eye(4), atol=1e-14)
    assert len(got) == 4 * len(rows)


def test_near_roots_are_told_apart(spark):
    """Eigenvalues that agree in twelve digits: doubles alone would mix their components."""
    poly = [10**30 * (10**30 + 1), -(2 * 10**30 + 1), 1]
    first, second = whitening.root(poly, 1), whitening.root(poly, 2)
    assert (first[3], second[3]) == (1, 1)
    value = lambda r: (2 * r[0] + 1) * 2.0 ** (r[1] - 1)
    assert value(first) >= value(second)
    matrix = np.array([[10**30 + 1, 0], [0, 10**30]], object)
    x = whitening.null_space(matrix.tolist(), first[0], first[1], 1, (2 * 10**30 + 1).bit_length())
    assert abs(abs(x[0, 0] / (1 << whitening.DIGITS)) - 1) < 1e-15 and abs(x[1, 0] / (1 << whitening.DIGITS)) < 1e-15


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_polynomial(spark, d):
    """Against Faddeev and LeVerrier's recursion; small entries give vanishing pivots."""
    rng = np.random.default_rng(d)
    for high in (2, 1 << 40):
        x = rng.integers(0, high, (d, d)).astype(object)
        a = x.T.dot(x)
        want, m = [1], np.zeros((d, d), object)
        for k in range(1, d + 1):
            m = a.dot(m) + np.eye(d, dtype=object) * want[-1]
            want.append(-(a.dot(m).trace()) // k)
        assert whitening.characteristic_polynomial(spark, a) == want[::-1]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i % 7, [float(x) for x in np.random.default_rng(i).normal(size=3)]) for i in range(50)]
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (5, [1.0]), (6, [])]
    rows = [*good, (None, [0.5, 0.5, 0.5]), *bad]
    df = table(spark, rows).withColumns({"n": F.lit(1), "_id": F.lit("x"), "component": F.lit(None).cast("int")})
    model, error, got = held(spark, df)
    assert model.n == 51 and len(got) == 51 * 3 and error < 1e-12 and got["vec_id"].isna().sum() == 3
    assert sorted(got["deviation"].astype(object).tolist())[::3] == sorted(brute([v for _, v in rows[:51]])[0])


def test_huge_entries(spark):
    """Entries whose products leave 64 bits, beside small ones."""
    rows = [(i, [10.0 * (i - 2), 1e12 * (i - 2) ** 2, 1e14 * (i - 2) ** 3]) for i in range(6)]
    df = table(spark, rows)
    _, error, got = held(spark, df)
    assert error < 1e-6
    for i, d in enumerate(brute([v for _, v in rows])[0]):
        shown = got[got["vec_id"] == i]["deviation"].iloc[0]
        assert (shown is None and d >= 10**38) or int(shown) == d
    assert np.isfinite(got["whitened"]).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    _, error, got = held(spark, table(spark, rows))
    assert got.empty and error == 0
