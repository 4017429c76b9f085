from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.plans.effects import CausalEffects
from lagweave.plans.graphs import Adjustment, TimeGraph, check, from_links, matches, projected, reverse
from lagweave.plans.models import LinearModel, Mediation, Prediction, bootstrap_effects
from lagweave.sources.panel import Panel
from lagweave.sources.processes import ensemble, random_links, stationary, structural_process, surrogates

CHAIN = {0: [((0, -1), 0.9, None)], 1: [((1, -1), 0.3, None), ((0, -1), 0.7, None)], 2: [((2, -1), 0.3, None), ((1, -1), 0.7, None)]}
PARENTS = {j: [p[0] for p in ps] for j, ps in CHAIN.items()}


@pytest.fixture(scope="module")
def panel(spark):
    return Panel.from_arrays(spark, structural_process(CHAIN, 4000, seed=21)[0])


def test_mediation(panel):
    m = Mediation.fit(panel, PARENTS, 2, standard=False)
    assert np.isclose(m.coefficient(0, 1, 1), 0.7, atol=0.05)
    assert np.isclose(m.effect(0, 2, 2), 0.49, atol=0.05) and np.isclose(m.mediated(0, 2, 2, 1), 0.49, atol=0.05)
    assert m.effect(2, 2, 0) == pytest.approx(0) and m.average_mediated(1) > m.average_mediated(0)
    assert np.isclose(m.joint([(0, -2)], 2), m.effect(0, 2, 2)) and np.isclose(m.conditional_mediated(0, 2, 2, 1, [0]), m.mediated(0, 2, 2, 1), atol=0.2)


def test_effect_interval(panel):
    low, high = bootstrap_effects(panel, PARENTS, 2, lambda m: m.effect(0, 2, 2), samples=20, block=10, standard=False)
    assert low < 0.52 and high > 0.46 and low < high


def test_model_and_residuals(panel):
    m = LinearModel.fit(panel, PARENTS)
    c = m.residual_covariance(panel)
    assert np.allclose(c, np.eye(3), atol=0.1)
    x = surrogates(m, c, 3000, seed=1)
    assert np.isclose(np.corrcoef(x[:-1, 0], x[1:, 1])[0, 1], 0.9, atol=0.15)


def test_prediction(panel):
    p = Prediction(panel, F.col("t") < 3000, F.col("t") >= 3000)
    chosen = p.predictors(2, 1, 2, 0.01)
    assert (1, -1) in chosen and (2, -1) in chosen
    p.fit(2, chosen, 2)
    r = p.predict().agg(F.corr("actual", "predicted"), F.count(F.lit(1))).first()
    assert r[0] > 0.6 and r[1] == 1000


def test_total_effects_agree(panel):
    e = CausalEffects(from_links(CHAIN), [(0, -2)], [(2, 0)]).fit(panel)
    own = e.effect()[(0, -2), (2, 0)]
    assert np.isclose(own, 0.49, atol=0.06)
    assert np.isclose(e.wright(panel, through=[(1, -1)])[(0, -2), (2, 0)], 0.49, atol=0.06)
    y = [r["y0"] for r in e.predict(panel, [[0.0], [1.0]]).orderBy("case").collect()]
    assert np.isclose(y[1] - y[0], own)
    low, high = e.bootstrap(panel, samples=20, block=5)[(0, -2), (2, 0)]
    assert low <= own + 0.05 and high >= own - 0.05


def test_adjustment_in_a_confounded_graph():
    g = np.full((4, 4), "", dtype="<U3")
    for i, j, link in ((3, 0, "-->"), (3, 1, "-->"), (0, 2, "-->"), (2, 1, "-->")):
        g[i, j], g[j, i] = link, reverse(link)
    a = Adjustment(g, [(0, 0)], [(1, 0)])
    assert a.m == {(2, 0)} and a.optimal() == {(3, 0)} and not a.valid([]) and not a.valid([(2, 0)]) and a.all_minimal() == [{(3, 0)}]
    g[0, 1], g[1, 0] = "<->", "<->"
    assert Adjustment(g, [(0, 0)], [(1, 0)]).optimal() is None


def test_all_minimal_adjustment_sets_of_any_size():
    """Five confounders, one of them by a chain of two nodes; against all subsets."""
    g = np.full((8, 8), "", dtype="<U3")
    for i, j in [(k, e) for k in range(2, 6) for e in (0, 1)] + [(6, 0), (6, 7), (7, 1), (0, 1)]:
        g[i, j], g[j, i] = "-->", "<--"
    a = Adjustment(g, [(0, 0)], [(1, 0)])
    want = []
    for d in range(7):
        want += [set(c) for c in combinations(sorted(a.possible), d) if a.valid(c) and not any(o <= set(c) for o in want)]
    assert a.all_minimal() == want and [len(c) for c in want] == [5, 5] and a.all_minimal(3) == []


def test_graph_tools():
    assert reverse("o->") == "<-o" and matches("-->", "*->") and not matches("", "***")
    g = TimeGraph(from_links(CHAIN), 4)
    assert g.paths([(0, -2)], [(2, 0)]) and g.ancestors([(0, -1)]) == {(0, -k) for k in range(1, 5)}
    assert g.separated([(0, -2)], [(2, 0)], [(1, -1), (2, -1)]) and not g.separated([(0, -2)], [(2, 0)], [])
    bad = np.full((2, 2), "", dtype="<U3")
    bad[0, 1] = bad[1, 0] = "-->"
    with pytest.raises(ValueError, match="mirror"):
        check(bad[:, :, None])


def test_projection():
    hidden = projected({0: [], 1: [(0, -1)], 2: [(0, -1), (1, -1)]}, [1, 2], 1)
    assert hidden[0, 1, 0] == hidden[1, 0, 0] == "<->" and hidden[0, 1, 1] == "-->"


def test_processes(spark):
    links = random_links(5, 5, 3, seed=2)
    assert stationary(links) and not stationary({0: [((0, -1), 1.1, None)]})
    assert ensemble(spark, links, 50, 3).groupBy("dataset").count().collect() and ensemble(spark, links, 50, 3).count() == 150
    do = {0: np.full(50, np.nan)}
    do[0][10:] = 5.0
    x, bad = structural_process(links, 50, seed=3, do=do)
    assert (x[10:, 0] == 5).all() and not bad
    with pytest.raises(ValueError, match="cycle"):
        structural_process({0: [((1, 0), 1, None)], 1: [((0, 0), 1, None)]}, 10)
