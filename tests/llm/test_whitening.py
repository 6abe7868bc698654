import numpy as np
import pandas as pd
import pytest

from corpus_rows import SF
from fieldpulse.llm import whitening as W


def by_eigenvectors(vectors):
    """The same from the covariance matrix of the distinct vectors."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    keep = e > 1e-9 * e[0]
    e, u = e[keep], u[:, keep]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(cov)


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)],
                                 "vec_id long, embedding array<double>").repartition(3)


def check(got, vectors):
    n, deviation, whitened, explained = by_eigenvectors(vectors)
    k = len(explained)
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == len(vectors) * k and got.component.tolist() == list(range(1, k + 1)) * len(vectors)
    assert set(got.n) == {n} and got.deviation.tolist() == np.repeat(deviation, k).tolist()
    own = got.whitened.to_numpy().reshape(-1, k)
    assert np.abs(own * np.sign((own * whitened).sum(axis=0)) - whitened).max() < 1e-8
    assert np.allclose(got.explained.to_numpy()[:k], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_given_table(spark):
    p = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    got = W.op12_whitening(spark, SF).toPandas()
    got["vec_id"] = got.vec_id.map({v: i for i, v in enumerate(p.vec_id)})
    check(got, p.embedding.tolist())


def test_repeated_vectors_count_once(spark):
    v = np.random.default_rng(3).normal(size=(40, 6))
    v = np.concatenate([v, np.repeat(v[:1], 60, axis=0)])
    check(W.whiten(frame(spark, v)).toPandas(), v)


@pytest.mark.parametrize("spread", [1.0, 1e3])
def test_dependent_and_constant_dimensions(spark, spread):
    v = np.random.default_rng(4).normal(size=(60, 6)) * [spread, 1, 1, 1, 1, 1]
    v[:, 3] = v[:, 0]
    v[:, 5] = 2.5
    check(W.whiten(frame(spark, v)).toPandas(), v)


def test_fewer_directions_than_components(spark):
    v = np.random.default_rng(5).normal(size=(30, 5))
    v[:, 2:] = v[:, :1]
    check(W.whiten(frame(spark, v)).toPandas(), v)
    check(W.whiten(frame(spark, np.arange(6.0).reshape(6, 1))).toPandas(), np.arange(6.0).reshape(6, 1))


def test_factors_make_rows_orthonormal(spark):
    x = np.random.default_rng(6).integers(-500, 500, size=(300, 8))
    x[:, 7] = x[:, 6] + (np.arange(300) % 2)  # near dependent
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(4)
    found, rest = W.factors(fit, x.mean(axis=0), 300)
    assert np.abs(rest - np.eye(8)).max() < W.CLOSE and all(np.allclose(f, np.triu(f)) for f in found)
    r = np.eye(8)
    for f in reversed(found):
        r = r @ f
    centred = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-10, atol=1e-3)


def test_left_out_rows(spark):
    v = np.random.default_rng(7).normal(size=(20, 3)).tolist()
    odd = [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], []]
    rows = [(i, x, "clash", 1) for i, x in enumerate(v + odd)] + [(None, v[0], "clash", 1), (3, v[3], "clash", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int")
    got = W.whiten(df).toPandas()
    assert len(got) == 22 * 3 and got.vec_id.isna().sum() == 3
    check(got[got.vec_id.notna()].drop_duplicates(["vec_id", "component"]), v)


def test_nothing_to_whiten(spark):
    for v in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]):
        df = spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "vec_id string, embedding array<float>")
        got = W.whiten(df)
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Deviations beyond 64 bits are null, those within are exact."""
    v = [[1e6, 0.0], [-1e6, 0.0], [0.0, 1.0]]
    got = W.whiten(frame(spark, v)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, _, _ = by_eigenvectors(v)
    assert got.deviation.tolist() == np.repeat(deviation, 2).tolist()
    v = [[4e6, 0.0], [-4e6, 0.0], [0.0, 1.0]]
    assert W.whiten(frame(spark, v)).toPandas().deviation.isna().sum() >= 4
