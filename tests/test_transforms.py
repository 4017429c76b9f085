import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import special, transforms as T
from lagweave.sources.panel import Panel


@pytest.fixture(scope="module")
def x():
    return np.round(np.cumsum(np.random.default_rng(2).standard_normal(120)), 1)


@pytest.fixture(scope="module")
def df(spark, x):
    return Panel.from_arrays(spark, x[:, None]).df


def column(frame, name):
    return np.array([r[name] for r in frame.orderBy("t").collect()], float)


def test_autocorrelation(df, x):
    got = [r["r"] for r in T.autocorrelation(df, "v0", 5).orderBy("lag").collect()]
    assert np.allclose(got, [1] + [np.corrcoef(x[k:], x[:-k])[0, 1] for k in range(1, 6)])
    assert all(1 <= T.block_length(d ** np.arange(40.0), 1000) <= 100 for d in (0.05, 0.5, 0.99))


def test_smoothing(df, x):
    t = np.arange(len(x))
    w = np.exp(-((t[:, None] - t) ** 2) / 16)
    assert np.allclose(column(T.smooth(df, "v0", 4, "gaussian"), "smoothed"), w @ x / w.sum(1))
    w = (np.abs(t[:, None] - t) < 3).astype(float)
    assert np.allclose(column(T.smooth(df, "v0", 6, residuals=True), "smoothed"), x - w @ x / w.sum(1))


def test_ranks(df, x):
    u = np.searchsorted(np.sort(x), x, "right") / len(x)
    assert np.allclose(column(T.uniform(df, "v0", "u"), "u"), u)
    z = column(T.normal_scores(df, "v0", out="z"), "z")
    assert np.allclose(z, [NormalDist().inv_cdf(0.999 if v >= 1 else v) for v in u], atol=1e-7)
    assert np.array_equal(column(T.ranks(df, "v0", "r"), "r"), np.argsort(np.argsort(x, kind="stable"), kind="stable"))


def test_bins_and_patterns(df, x):
    edges = np.sort(x)[:: math.ceil(len(x) / 7)]
    assert np.array_equal(column(T.quantile_bins(df, "v0", 7), "symbol"), (x[:, None] >= edges).sum(1) - 1)
    got = column(T.ordinal_patterns(df, "v0", 3, 2), "pattern")
    want = [int(a < b) + 2 * int(a < c) + 2 * int(b < c) for a, b, c in zip(x, x[2:], x[4:])]
    assert np.array_equal(got, want)
    assert np.allclose(column(T.time_bins(df, ["v0"], 7), "v0"), x[: 120 // 7 * 7].reshape(-1, 7).mean(1))


def test_weighted(df, x):
    mean, std = T.weighted_mean_std("v0", "w")
    r = df.withColumn("w", F.col("t") + 1.0).agg(mean.alias("m"), std.alias("s")).first()
    w = np.arange(1.0, 121)
    m = (w * x).sum() / w.sum()
    assert np.isclose(r["m"], m) and np.isclose(r["s"], np.sqrt((w * (x - m) ** 2).sum() / w.sum()))


def test_pass_filters(spark):
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 4)
    df = Panel.from_arrays(spark, (slow + fast)[:, None]).df
    low, high = column(T.pass_filter(df, "v0", 20, "low"), "filtered"), column(T.pass_filter(df, "v0", 20, "high"), "filtered")
    assert np.abs(low - slow)[50:350].max() < 0.02 and np.abs(high - fast)[50:350].max() < 0.02


def test_values_that_miss_or_repeat(spark):
    df = spark.createDataFrame([("0", t, x) for t, x in enumerate([3.0, None, 1.0, 3.0, 3.0, 2.0])], "dataset string, t long, v0 double")
    assert [r["u"] for r in T.uniform(df, "v0", "u").orderBy("t").collect()] == [1.0, None, 0.2, 1.0, 1.0, 0.4]
    assert [r["r"] for r in T.ranks(df, "v0", "r").orderBy("t").collect()] == [2, None, 0, 3, 4, 1]
    assert [r["symbol"] for r in T.quantile_bins(df, "v0", 2).orderBy("t").collect()] == [1, None, 0, 1, 1, 0]


def test_patterns_with_masks_noise_and_weights(df, x):
    masked = df.withColumn("m", F.col("t") == 10)
    got = T.ordinal_patterns(masked, "v0", 3, 2, mask="m", weights=True)
    assert sorted(set(range(116)) - {r["t"] for r in got.collect()}) == [6, 8, 10]
    w = {r["t"]: r["weight"] for r in got.collect()}
    assert np.isclose(w[0], np.var(x[[0, 2, 4]]))
    flat = df.withColumn("v0", F.lit(1.0) + (F.col("t") > 200).cast("double"))
    assert T.ordinal_patterns(flat, "v0", 2).where("pattern <> 0").count() == 0
    noisy = [r["pattern"] for r in T.ordinal_patterns(df.withColumn("v0", F.round("v0")), "v0", 2, noise_seed=1).collect()]
    assert 0 < np.mean(noisy) < 1


def test_filters_do_not_see_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = Panel.from_arrays(spark, rng.standard_normal((900, 1)).cumsum(0)).df
    original = T.overlapping
    for kind in ("low", "high"):
        whole = column(T.pass_filter(df, "v0", 12, kind), "filtered")
        monkeypatch.setattr(T, "overlapping", lambda df, before, after=0, block=0: original(df, before, after, 64))
        assert np.allclose(column(T.pass_filter(df, "v0", 12, kind), "filtered"), whole, atol=1e-9)
        monkeypatch.setattr(T, "overlapping", original)
    b, a = T.butterworth(0.2, False)
    r = T.Recursion(b, a)
    v = rng.standard_normal(300)
    assert np.allclose(r.run(v), r.slow(v, r.steady * v[0])[0])


def test_special_functions():
    # Values from tables of the distributions.
    assert np.isclose(2 * special.t_sf(2.228139, 10), 0.05, atol=1e-6)
    assert np.isclose(special.t_ppf(0.975, 10), 2.228139, atol=1e-6)
    assert np.isclose(special.chi2_sf(3.841459, 1), 0.05, atol=1e-6) and np.isclose(special.chi2_sf(18.307038, 10), 0.05, atol=1e-6)
    assert np.allclose(special.digamma(np.array([1.0, 0.5, 10])), [-0.5772156649, -1.9635100260, 2.2517525891])
