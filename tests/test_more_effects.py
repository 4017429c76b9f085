"""Joint and path effects, Wright's method, intervals of predictions, learnt conditions, separation with selection."""

import numpy as np
import pytest

from lagweave.operators.ci import OracleCI, ParCorr, Question
from lagweave.operators.significance import AugmentedPairwise, run_test_raw
from lagweave.plans.effects import CausalEffects
from lagweave.plans.general import GeneralEffects, predicted_intervals
from lagweave.plans.graphs import from_links, reverse
from lagweave.plans.models import Mediation
from lagweave.sources.panel import Panel
from lagweave.sources.processes import structural_process


@pytest.fixture
def model():
    phi = np.zeros((3, 3, 3))
    phi[1, 0, 0], phi[1, 1, 0], phi[0, 2, 1], phi[2, 2, 0], phi[1, 2, 2] = 0.8, 0.5, 0.4, 0.3, 0.6
    return Mediation(phi)


def test_paths_sum_to_the_effect(model):
    for tau in range(3):
        for i in range(3):
            for j in range(3):
                if (i, tau) != (j, 0):
                    assert sum(c for _, c in model.paths(i, tau, j)) == pytest.approx(model.effect(i, tau, j))
    assert model.paths(0, 1, 2) == [([(0, -1), (1, 0), (2, 0)], 0.5 * 0.4)]


def test_joint_effects(model):
    for tau in range(3):
        free = [(p, c) for p, c in model.paths(0, tau, 2) if all(v != 0 for v, _ in p[1:])]
        assert model.joint_effect(0, 2)[tau] == pytest.approx(sum(c for _, c in free))
        assert model.joint_mediated(0, 2, 1)[tau] == pytest.approx(sum(c for p, c in free if any(v == 1 for v, _ in p)))
    m = model.joint_matrix(0, 2)
    assert m[2, 1] == model.joint_effect(0, 2)[1] and m[0, 1] == 0 and m.shape == (3, 3)


def test_wright(spark):
    links = {0: [((0, -1), 0.5, None)], 1: [((0, -1), 0.7, None), ((1, -1), 0.3, None)], 2: [((1, 0), 0.6, None), ((0, -1), 0.4, None)]}
    panel = Panel.from_arrays(spark, structural_process(links, 3000, seed=2)[0])
    e = CausalEffects(from_links(links), [(0, -1)], [(2, 0)])
    given = {((i, lag), (j, 0)): c for j, ps in links.items() for (i, lag), c, _ in ps}
    truth = 0.4 + 0.7 * 0.6
    assert e.wright(None, method="links", coefficients=given)[(0, -1), (2, 0)] == pytest.approx(truth)
    a, b = (e.wright(panel, method=m)[(0, -1), (2, 0)] for m in ("parents", "optimal"))
    assert a == pytest.approx(truth, abs=0.08) and b == pytest.approx(truth, abs=0.08)
    g = np.full((2, 2, 1), "", dtype="<U3")
    g[0, 1, 0], g[1, 0, 0] = "+->", reverse("+->")
    with pytest.raises(ValueError):
        CausalEffects(g, [(0, 0)], [(1, 0)]).wright(panel)
    with pytest.raises(ValueError):
        e.wright(panel, method="other")


def test_intervals_of_predictions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    panel = Panel.from_arrays(spark, np.stack([x, 2 * x + rng.normal(size=400)], axis=1))
    e = GeneralEffects(from_links({0: [], 1: [(0, 0)]}), [(0, 0)], [(1, 0)]).fit(panel)
    got = predicted_intervals(e, [[0.0], [1.0]], samples=60)
    assert all(low < want < high for [(low, high)], want in zip(got, [0, 2])) and all(high - low < 0.5 for [(low, high)] in got)


def test_learnt_conditions():
    rng = np.random.default_rng(1)
    n = 600
    y1 = rng.normal(size=n)
    x = rng.normal(size=n)
    y2 = 3 * y1 + 0.5 * x + 0.3 * rng.normal(size=n)
    t = AugmentedPairwise(alpha=0.1)
    linked = t.raw(x, np.stack([y1, y2], axis=1))
    plain = run_test_raw(ParCorr(), x, y2)
    assert abs(linked.val) > 2 * abs(plain[0]) and linked.p < 1e-10
    assert t.raw(x, rng.normal(size=(n, 2))).p > 0.01


def test_separation_with_selection_and_graphs():
    ask = lambda o, *q: o.run(None, [Question(*q)])[0].val
    links = {0: [], 1: [], 2: [(0, 0), (1, 0)]}
    assert ask(OracleCI(links), ((0, 0),), ((1, 0),)) == 0 and ask(OracleCI(links, selected=[2]), ((0, 0),), ((1, 0),)) == 1
    g = np.full((2, 2, 1), "", dtype="<U3")
    g[0, 1, 0] = g[1, 0, 0] = "<->"
    assert ask(OracleCI.of_graph(g), ((0, 0),), ((1, 0),)) == 1
