"""Eigenvectors, sums and whitened vectors against direct computation, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import whitening
from adjudica.llm.queries import QUERIES
from adjudica.llm.symmetric_eigen import leading_eigen, sturm_counts, tridiagonal, turned_back

SCHEMA = "vec_id long, embedding array<float>, deviation string, vector int, whitened string"


def matrices():
    source = np.random.default_rng(0)
    turned, _ = np.linalg.qr(source.normal(size=(24, 24)))
    clustered = turned @ np.diag([5.0] * 8 + [3.0] * 8 + [0.0] * 8) @ turned.T
    return {
        "random": np.cov(source.normal(size=(99, 24)).T),
        "identity": 3 * np.eye(24),
        "zero": np.zeros((5, 5)),
        "one": np.array([[2.0]]),
        "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
        "clustered": (clustered + clustered.T) / 2,
        "graded": np.diag(10.0 ** -np.arange(24)),
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_leading_eigen(name):
    matrix = matrices()[name]
    values, vectors = leading_eigen(matrix, 16)
    expected = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    norm = max(expected.max(), 1e-300)
    assert np.abs(values - expected).max() <= 1e-13 * norm + 1e-300
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * norm + 1e-300
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_tridiagonal_form_and_counts():
    matrix = matrices()["random"]
    diagonal, off, reflectors = tridiagonal(matrix)
    form = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    q = turned_back(reflectors, np.eye(len(matrix)))
    assert np.allclose(q @ form @ q.T, matrix, atol=1e-13)
    at = np.linspace(-1, 4, 50)
    assert sturm_counts(diagonal, off, at).tolist() == [int((np.linalg.eigvalsh(matrix) < v).sum()) for v in at]


def exact(vectors):
    """n, S and the sum of (n·x − S)² of each vector in Python's whole numbers."""
    xs = [[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(xs), [sum(column) for column in zip(*xs)]
    return n, sums, [sum((n * v - s) ** 2 for v, s in zip(x, sums)) for x in xs], xs


def test_query_agrees_with_direct_computation(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    n, sums, deviations, xs = exact([r["embedding"] for r in rows])
    y = np.array([[v - s / n for v, s in zip(x, sums)] for x in xs])
    covariance = y.T @ y / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    found = QUERIES["op13_whitening"](spark, small).orderBy("vec_id", "component").collect()
    assert len(found) == 32 * n
    assert [r["deviation"] for r in found[::32]] == deviations
    assert {r["n"] for r in found} == {n} and [r["component"] for r in found[:32]] == list(range(1, 33))
    assert found[0]["identity_error"] < 1e-8 and len({r["identity_error"] for r in found}) == 1
    explained = np.array([r["explained"] for r in found[:32]])
    assert np.allclose(explained, values / np.trace(covariance), rtol=1e-9)
    white = np.array([r["whitened"] for r in found]).reshape(n, 32)
    expected = y @ (axes / np.sqrt(values))
    signs = np.sign((white * expected).sum(axis=0))
    assert np.allclose(white, expected * signs, atol=1e-7)


ODD = [
    (1, [0.5, 1.0], "d", 1, "w"), (1, [0.5, 1.0], "d", 1, "w"), (2, [0.25, -1.0], "d", 1, "w"),
    (None, [0.0, 3.0], "d", 1, "w"), (3, None, "d", 1, "w"), (4, [], "d", 1, "w"),
    (5, [0.1, None], "d", 1, "w"), (6, [float("nan"), 0.1], "d", 1, "w"),
    (7, [float("inf"), 0.1], "d", 1, "w"), (8, [1.0, 2.0, 3.0], "d", 1, "w"), (9, [1e30, 0.0], "d", 1, "w"),
]


def test_odd_rows_and_clashing_columns(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    fit = whitening.fit_whitening(frame)
    n, sums, deviations, _ = exact([v for _, v, *_ in ODD[:4]])
    assert (fit.n, list(fit.sums)) == (n, sums) and len(fit.variances) == 2 and fit.identity_error < 1e-9
    out = whitening.whiten(frame, fit).collect()
    assert sorted((r["vec_id"] or 0, int(r["deviation"])) for r in out) == sorted(
        (r[0] or 0, d) for r, d in zip(ODD[:4], deviations)
    )
    assert all(len(r["whitened"]) == 2 for r in out)


@pytest.mark.parametrize("vector", [[], [1.0, 2.0]])
def test_a_table_without_variance_gives_no_component(spark, vector):
    frame = spark.createDataFrame([(1, vector), (2, vector)], "vec_id long, embedding array<float>")
    fit = whitening.fit_whitening(frame)
    assert fit.n == 2 and not len(fit.variances)
    assert [r["whitened"] for r in whitening.whiten(frame, fit).collect()] == [[], []]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.fit_whitening(frame) is None
    assert whitening.whiten(frame, None).count() == 0


def test_deviations_beyond_a_long_are_exact():
    x = np.array([[2**50, 5], [0, -5]])
    n, sums = 10**6, (2**50, 3)
    expected = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, n, sums) == expected
