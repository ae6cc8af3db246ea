import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening
from tessera.llm.common import read

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, x string"


def plain(vectors, most=32):
    """Eigenvectors of the covariance of fixed-point rows, by a dense solver."""
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    return ((n * x - s) ** 2).sum(1), c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(out, ids, vectors):
    deviation, white, explained = plain(vectors)
    k = white.shape[1]
    assert len(out) == len(ids) * k
    w = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((w * white).sum(0))
    assert np.abs(w - white * sign).max() < 1e-8
    assert (out.groupby("vec_id").deviation.first().loc[ids].to_numpy() == deviation).all()
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-8
    assert (out.n == len(ids)).all()


def test_equals_a_dense_solver(spark, sf):
    out = whitening.op12_whitening(spark, sf).toPandas()
    rows = read(spark, sf, "embeddings").toPandas()
    rows = rows[rows.embedding.map(lambda v: v is not None and bool(np.isfinite(np.array(v, float)).all()))]
    compare(out, rows.vec_id.tolist(), rows.embedding.tolist())


def test_cases(spark):
    r = np.random.default_rng(3)
    good = [[float(x) for x in v] for v in r.normal(size=(40, 5)) * [1, 5, 0.5, 30, 2]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100, good[0]), (101, None), (102, []), (103, [1.0, None, 2.0, 3.0, 4.0]), (104, [float("nan")] * 5), (105, [float("inf")] * 5), (106, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA).repartition(5)
    out = whitening.whiten(table).toPandas()
    compare(out, [*range(40), 100], [*good, good[0]])


def test_null_and_repeated_ids_and_few_dimensions(spark):
    r = np.random.default_rng(4)
    flat = r.normal(size=(30, 2)) @ r.normal(size=(2, 6)) * 100  # two dimensions but for the rounding to fixed point
    rows = [(None if i < 2 else 7, [float(np.round(x)) for x in v]) for i, v in enumerate(flat)]
    doubled = [(i, [*v[:3], v[0], v[1], 5.0]) for i, v in rows]  # rank three
    out = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "", "") for i, v in doubled], SCHEMA)).toPandas()
    assert sorted(out.component.unique()) == [1, 2, 3] and len(out) == 90
    assert out.vec_id.isna().sum() == 6 and out.identity_error.iloc[0] < 1e-8
    assert out.explained.unique().sum() == pytest.approx(1)


def test_empty_equal_and_huge(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(empty.union(spark.createDataFrame([(i, [1.0, 2.0], 0, "", "", "") for i in range(3)], SCHEMA))).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 0.0], 0, "", "", ""), (1, [-1e30, 1.0], 0, "", "", ""), (2, [0.0, 2.0], 0, "", "", "")], SCHEMA)
    out = whitening.whiten(huge).toPandas()
    assert out[out.vec_id == 0].deviation.isna().all() and out[out.vec_id == 2].deviation.isna().sum() == 0


@pytest.mark.parametrize("condition", [1.0, 1e3, 1e6])
def test_bidiagonalisation_keeps_its_vectors_orthogonal(condition):
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 20)) * np.geomspace(1, 1 / condition, 20) @ np.linalg.qr(r.normal(size=(20, 20)))[0]
    made = whitening.Bidiagonal(lambda w: np.append((x @ w) @ (x @ w), x.T @ (x @ w)), 20)
    made.run()
    u = x @ made.w
    assert np.abs(made.v.T @ made.v - np.eye(20)).max() < 1e-13
    assert np.abs(u.T @ u - np.eye(20)).max() < 1e-9 * condition
    assert np.abs(x @ made.v - u @ (np.diag(made.alpha) + np.diag(made.beta, 1))).max() < 1e-9
    s, q = made.components()
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False), rtol=1e-8)
    assert np.abs(x.T @ (x @ q) - q * s**2).max() < 1e-9 * s[0] ** 2


def test_repeated_deviations():
    """Equal singular values end the recurrence early; it goes on with a new direction."""
    x = np.diag([3.0, 3, 3, 2, 2, 0, 0])
    made = whitening.Bidiagonal(lambda w: np.append((x @ w) @ (x @ w), x.T @ (x @ w)), 7)
    made.run()
    s, q = made.components()
    assert np.allclose(s, [3, 3, 3, 2, 2, 0, 0], atol=1e-9)
    assert np.abs(x.T @ (x @ q) - q * s**2).max() < 1e-9


def test_entries_are_floored_as_doubles(spark):
    rows = spark.createDataFrame([(0, [-0.01, 0.0156250001], 0, "", "", "")], SCHEMA)
    assert whitening.fixed_point(rows).select(F.col("x")).first()[0] == [999_999, 1_000_001]
