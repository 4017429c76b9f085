import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators.embedding import column, lagged, roles, sample
from lagweave.operators.moments import moments
from lagweave.sources.panel import Panel


def brute(x, nodes, first, keep=lambda t: True):
    return [tuple(x[t + lag, v] for v, lag in nodes) for t in range(first, len(x)) if keep(t)]


def rows(s):
    return [tuple(r[column(n)] for n in s.nodes) for r in s.df.orderBy("dataset", "t").collect()]


@pytest.fixture(scope="module")
def ramp():
    return np.arange(400.0).reshape(4, 100).T.copy()


@pytest.mark.parametrize(("cut_off", "first"), [("2xtau_max", 6), ("max_lag", 2), ("tau_max", 3), ("max_lag_or_tau_max", 3)])
def test_cut_offs(spark, ramp, cut_off, first):
    s = sample(Panel.from_arrays(spark, ramp), [(0, -1)], [(1, 0)], [(2, -2)], [(3, 0)], tau_max=3, cut_off=cut_off)
    assert rows(s) == brute(ramp, s.nodes, first)


def test_future_cut_off_counts_as_the_default(spark, ramp):
    p = Panel.from_arrays(spark, ramp)
    counts = {c: sample(p, [(0, -1)], [(1, 0)], tau_max=3, cut_off=c).df.count() for c in ("2xtau_max", "2xtau_max_future")}
    assert counts["2xtau_max"] == counts["2xtau_max_future"] == 94


def test_blocks_do_not_show(spark, ramp):
    p = Panel.from_arrays(spark, {"a": ramp, "b": ramp[:37] * 2})
    nodes = [(0, 0), (1, -1), (2, -5)]
    by = lambda block: [tuple(r) for r in lagged(p, nodes, 5, block=block).orderBy("dataset", "t").collect()]
    assert by(7) == by(1000)


def test_missing_and_masks(spark, ramp):
    rng = np.random.default_rng(0)
    x = ramp.copy()
    gaps = rng.random(x.shape) < 0.1
    x[gaps] = 999
    mask = (rng.random(x.shape) < 0.2).astype(int)
    p = Panel.from_arrays(spark, x, mask=mask, missing_flag=999)
    nodes = [(0, -1), (1, 0), (2, -2)]
    whole = lambda t: not any(gaps[t + lag, v] for v, lag in nodes)
    assert rows(sample(p, [nodes[0]], [nodes[1]], [nodes[2]], tau_max=2)) == brute(x, nodes, 4, whole)
    own = lambda t: whole(t) and not mask[t, 1] and not mask[t - 2, 2]
    assert rows(sample(p, [nodes[0]], [nodes[1]], [nodes[2]], tau_max=2, mask_type="yz")) == brute(x, nodes, 4, own)
    spread = lambda t: all(whole(s) for s in range(max(4, t - 2), t + 1))
    assert rows(sample(p, [nodes[0]], [nodes[1]], [nodes[2]], tau_max=2, spread_missing=True)) == brute(x, nodes, 4, spread)


def test_roles(spark, ramp):
    p = Panel.from_arrays(spark, ramp)
    p.vectors = {4: [(0, -1), (2, 0)]}
    assert roles(p, [(4, -1)], [(1, 0), (1, 0)], [(1, 0), (3, -1), (0, -2)], [(3, -1), (2, -3)]) == ([(0, -2), (2, -1)], [(1, 0)], [(3, -1)], [(2, -3)])
    with pytest.raises(ValueError, match="not positive"):
        roles(p, [(0, 1)], [(1, 0)])
    with pytest.raises(ValueError, match="no variable"):
        roles(p, [(9, 0)], [(1, 0)])


def test_panel_checks(spark, ramp):
    with pytest.raises(ValueError, match="NaN"):
        Panel.from_arrays(spark, np.array([[np.nan]]))
    with pytest.raises(ValueError, match="mask"):
        Panel.from_arrays(spark, ramp, mask=ramp)
    with pytest.raises(ValueError, match="offsets"):
        Panel.from_spark(spark.range(3), "id", ["id"], offsets={"0": 1})
    Panel.from_arrays(spark, ramp).check()


def test_reference_points_and_offsets(spark, ramp):
    df = Panel.from_arrays(spark, {"a": ramp, "b": ramp}).df
    p = Panel.from_spark(df, "t", ["v0"], dataset="dataset", gapless=True, offsets={"a": 0, "b": 10}, anchors=[5, 12])
    assert [(r["dataset"], r["t"]) for r in lagged(p, [(0, 0)], 0).orderBy("dataset", "t").collect()] == [("a", 5), ("a", 12), ("b", 2)]


def test_moments(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3)) * [1, 1e3, 1e-3] + [0, 1e6, 5]
    nodes = [(0, 0), (1, -1), (2, -2)]
    m = moments(lagged(Panel.from_arrays(spark, x), nodes, 2), nodes)[()]
    want = np.stack([x[2:, 0], x[1:-1, 1], x[:-2, 2]])
    assert m.n == 198 and np.allclose(m.mean, want.mean(1)) and np.allclose(m.cov, np.cov(want, bias=True), rtol=1e-9)
    keyed = moments(lagged(Panel.from_arrays(spark, x), nodes, 2).withColumn("k", (F.col("t") % 2).cast("string")), nodes, ["k"])
    assert keyed[("0",)].n == 99 and np.allclose(keyed[("1",)].mean, want[:, 1::2].mean(1))
