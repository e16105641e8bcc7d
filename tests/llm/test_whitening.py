import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bedtrace.llm import whitening
from tests.llm.conftest import SF


def graded(rng, n, span):
    """A square matrix with singular values from 1 to 10^-span."""
    u, v = (np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(2))
    return u * np.logspace(0, -span, n) @ v.T


@pytest.mark.parametrize("kind", ["random", "graded", "ties", "identity", "rank", "zero", "one"])
def test_singular_values_and_vectors(kind):
    rng = np.random.default_rng(3)
    r = {"random": rng.normal(size=(40, 40)), "graded": graded(rng, 30, 8), "ties": np.linalg.qr(rng.normal(size=(24, 24)))[0] * np.repeat([5.0, 2, 1], 8),
         "identity": np.eye(12), "rank": rng.normal(size=(20, 6)) @ rng.normal(size=(6, 20)), "zero": np.zeros((5, 5)), "one": np.array([[-3.0]])}[kind]
    lam, v = whitening.singular(r)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(np.maximum(lam, 0)), want, atol=1e-13 * max(1, want[0]), rtol=1e-9)
    keep = want > 1e-10 * max(want[0], 1e-300)
    assert np.allclose((v.T @ v)[np.ix_(keep, keep)], np.eye(keep.sum()), atol=1e-10)
    assert np.allclose(r.T @ (r @ v[:, keep]), v[:, keep] * lam[keep], atol=1e-12 * max(1, want[0]) ** 2)


def test_dqds_keeps_small_values_to_full_relative_accuracy():
    a, b = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1e-3, 1e-7, 1e-11])
    lam = whitening.dqds((a * a).tolist(), (b * b).tolist())
    from fractions import Fraction as Q

    prod = Q(1)
    for x in a.tolist():
        prod *= Q(x) ** 2
    got = Q(1)
    for x in lam:
        got *= Q(x)
    assert abs(got / prod - 1) < Q(1, 10**14)  # the determinant has the smallest value as a factor


def test_equals_dense_eigenvectors_on_a_whole_table(spark):
    path = f"{SF}/embeddings.parquet"
    rows = duckdb.connect().execute(f"select vec_id, embedding from '{path}' where embedding is not null").fetchall()
    keep = [(i, v) for i, v in rows if None not in v and np.isfinite(v).all()]
    x = np.floor(64 * np.array([v for _, v in keep], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, vec = np.linalg.eigh(y.T @ y / n)
    e, vec = e[::-1], vec[:, ::-1]
    got = whitening.op12_embedding_whitening(spark, SF).toPandas()
    k = min(32, x.shape[1])
    assert len(got) == n * k and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in keep]].to_numpy()
    want = y @ vec[:, :k] / np.sqrt(e[:k])
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-8)
    assert np.allclose(got.groupby("component").explained.first(), e[:k] / e.sum(), rtol=1e-9)
    dev = got.groupby("vec_id").deviation.first()
    assert dev.to_dict() == {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for (i, _), r in zip(keep, x)}


def test_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]),
                                                                     (54, [float("inf"), 0.0, 0.0]), (55, [1.0, 2.0]), (0, rng.normal(size=3).tolist()), (56, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("other")).withColumn("component", F.lit("x"))
    out = whitening.whiten(df, ["vec_id", "n"])
    assert out.columns == ["vec_id", *whitening.OUT.fieldNames()]
    got = out.collect()
    assert len(got) == 42 * 3 and {r.n for r in got} == {42} and max(r.identity_error for r in got) < 1e-12
    assert {r.vec_id for r in got} == {*range(40), None}
    assert whitening.whiten(df.limit(0), ["vec_id"]).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same, ["vec_id"]).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(line, ["vec_id"]).count() == 5  # one direction has variance


def test_triangles_meet_in_a_tree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * [1, 2, 3, 4]).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(70)
    m = whitening.fit(df)
    y = np.floor(64 * np.array([v for _, v in rows])) + 1_000_000
    assert np.allclose(m.values, np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1], rtol=1e-10)
