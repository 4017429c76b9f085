"""Several datasets with context, and regimes."""

import numpy as np
import pytest

from lagweave.operators.ci import ParCorr, Question
from lagweave.plans.joint import JointDiscovery, RegimeDiscovery, persistent_path
from lagweave.sources.panel import Panel
from lagweave.sources.processes import context_model, structural_process


def residual(v, z):
    return v - z @ np.linalg.lstsq(z, v, rcond=None)[0]


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(0)
    out = {}
    for m in range(4):
        x = structural_process({0: [((0, -1), 0.5, None)], 1: [((1, -1), 0.4, None), ((0, -1), 0.5, None)]}, 60, seed=m)[0]
        out[str(m)] = x + rng.normal(0, 2, 2)
    return out


def test_dummies_equal_indicator_columns(spark, sets):
    """Partial correlations with one-hot columns made by hand."""
    found = JointDiscovery(Panel.from_arrays(spark, sets), {2: "space_dummy", 3: "time_dummy"})
    found.at(1)
    keys = sorted(sets)
    x, y, z = (np.concatenate([sets[k][2 - lag : 60 - lag, j] for k in keys]) for j, lag in ((0, 1), (1, 0), (1, 1)))
    space = np.kron(np.eye(4), np.ones((58, 1)))
    time = np.kron(np.ones((4, 1)), np.eye(58))
    n = len(x)
    for z_nodes, hot, more in (((2, 0),), space, 4), (((3, 0),), time, 58), (((2, 0), (3, 0)), np.concatenate([space, time], axis=1), 62):
        given = np.concatenate([hot, z[:, None]], axis=1)
        r = np.corrcoef(residual(x, given), residual(y, given))[0, 1]
        a = found.answer(Question(((0, -1),), ((1, 0),), ((1, -1), *z_nodes)))
        assert a.val == pytest.approx(r, abs=1e-8) and a.p == pytest.approx(ParCorr.p_value(r, n, 3 + more), abs=1e-8)
    given = np.stack([np.ones(n), z], axis=1)
    each = [np.corrcoef(residual(space[:, k], given), residual(y, given))[0, 1] for k in range(4)]
    a = found.answer(Question(((2, 0),), ((1, 0),), ((1, -1),)))
    assert abs(a.val) == pytest.approx(max(map(abs, each))) and a.p == pytest.approx(min(1, 4 * ParCorr.p_value(a.val, n, 1 + 4 + 1)))


def test_context_is_found(spark):
    links = {0: [((0, -1), 0.4, None), ((2, 0), 0.9, None), ((3, 0), 0.9, None)], 1: [((1, -1), 0.4, None), ((0, -1), 0.6, None)], 2: [((2, -1), 0.3, None)], 3: []}
    df = context_model(spark, links, {2: "time_context", 3: "space_context"}, 12, 80, seed=3)
    panel = Panel.from_spark(df, "t", [f"v{k}" for k in range(4)], dataset="dataset", gapless=True)
    f = JointDiscovery(panel, {2: "time_context", 3: "space_context", 4: "time_dummy", 5: "space_dummy"}).run_jpcmciplus(1, pc_alpha=0.001)
    assert f.graph[2, 0, 0] == "-->" and f.graph[3, 0, 0] == "-->" and f.graph[0, 2, 0] == "<--"
    assert f.graph[0, 0, 1] == f.graph[1, 1, 1] == f.graph[0, 1, 1] == "-->"
    assert f.graph[2, 1, 0] == f.graph[3, 1, 0] == "" and not (f.graph[:, 2] == "-->").any() and not (f.graph[:, 4:] == "-->").any()


def test_dummy_stands_for_hidden_context(spark):
    """A hidden shift of the datasets links 0 and 1; with the dataset's dummy, which takes its place, the link is gone."""
    rng = np.random.default_rng(1)
    sets = {str(m): rng.normal(size=(250, 2)) + rng.normal(0, 3) for m in range(10)}
    panel = Panel.from_arrays(spark, sets)
    without = JointDiscovery(panel, {}).run_jpcmciplus(1, pc_alpha=0.001)
    f = JointDiscovery(panel, {2: "space_dummy"}).run_jpcmciplus(1, pc_alpha=0.001)
    assert without.graph[0, 1, 0] != "" and f.graph[0, 1, 0] == "" and "-->" in (f.graph[2, 0, 0], f.graph[2, 1, 0])


def test_classes_are_checked(spark, sets):
    panel = Panel.from_arrays(spark, sets)
    for classes in ({0: "other"}, {0: "space_dummy"}, {2: "system"}):
        with pytest.raises(ValueError):
            JointDiscovery(panel, classes)


def test_persistent_path_is_the_cheapest():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(30):
        k, n, s = int(rng.integers(1, 4)), int(rng.integers(1, 7)), int(rng.integers(0, 4))
        cost = rng.random((k, n))
        best = min(sum(cost[r, t] for t, r in enumerate(p)) for p in product(range(k), repeat=n) if sum(a != b for a, b in zip(p, p[1:])) <= s)
        path, total = persistent_path(cost, s)
        assert total == pytest.approx(best) == sum(cost[r, t] for t, r in enumerate(path)) and (np.diff(path) != 0).sum() <= s


def test_regimes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    for t in range(1, 400):
        x[t, 1] += (0.95 if t < 200 else -0.95) * 2 * x[t - 1, 0]
    found = RegimeDiscovery(Panel.from_arrays(spark, x), seed=3).run_rpcmci(2, 1, annealings=6, iterations=8)
    label = np.array([r["regime"] for r in found.times.orderBy("t").collect()])
    first, last = np.bincount(label[:190], minlength=2), np.bincount(label[-190:], minlength=2)
    assert first.max() / 190 > 0.9 and last.max() / 190 > 0.9 and first.argmax() != last.argmax()
    assert all(f.graph[0, 1, 1] == "-->" for f in found.found.values())
    signs = {k: np.sign(f.val[0, 1, 1]) for k, f in found.found.items()}
    assert sorted(signs.values()) == [-1, 1]
