"""Effects by estimators, counterfactual worlds, graph algorithms, generators, files, panels from the data's range."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import transforms as T
from lagweave.operators.embedding import lagged
from lagweave.operators.moments import moments, numbered, resampled_moments
from lagweave.plans.general import ByCategory, GeneralEffects, KernelDensity, LeastSquares, NaturalEffects, Nearest, Standardised, TransferKernel, mediation_set, natural_effects, smoothed_curve
from lagweave.plans.graphs import Adjustment, TimeGraph, canonical, from_links, relevant_lag, reverse
from lagweave.plans.pcmci import Discovery, directed_member
from lagweave.sources import counterfactual as C
from lagweave.sources.files import described, printed, read_npy, read_null_distribution, read_text, write_null_distribution
from lagweave.sources.panel import Panel, on_spine
from lagweave.sources.processes import NONLINEAR, context_model, parents_of_links, random_links, random_noises, structural_process, surrogates, var_process


def marks(links, n):
    graph = np.full((n, n, 1), "", dtype="<U3")
    for (i, j), mark in links.items():
        graph[i, j, 0], graph[j, i, 0] = mark, reverse(mark)
    return graph


# -- effects


def test_estimators():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 1 + x @ [2.0, -1.0]
    assert np.allclose(LeastSquares().fit(x, y).predict(x[:5]), y[:5])
    assert np.allclose(Standardised(LeastSquares()).fit(x, y).predict(x[:5]), y[:5])
    near = Nearest(3).fit(x, y).predict(x[:4])
    for k in range(4):
        assert near[k] == pytest.approx(y[np.argsort(((x - x[k]) ** 2).sum(1))[:3]].mean())
    c = np.column_stack([rng.integers(0, 2, 400), x[:, 0]]).astype(float)
    target = np.where(c[:, 0] > 0, 3 * c[:, 1], -c[:, 1])
    fit = ByCategory(LeastSquares, [True, False]).fit(c, target)
    assert np.allclose(fit.predict(c), target) and np.allclose(fit.predict(np.array([[7.0, 1.0]])), target.mean())
    grid = np.linspace(-4, 4, 2001)[:, None]
    assert abs(KernelDensity(0.3).fit(x[:, :1]).density(grid).sum() * 0.004 - 1) < 1e-3
    label = (x[:, 0] > 0).astype(float)
    p = TransferKernel([0.0, 1.0], [False, False], 0.3).fit(x, label).predict(np.array([[2.0, 0.0], [-2.0, 0.0]]))
    assert p[0, 1] > 0.9 > 0.1 > p[1, 1] and np.allclose(p.sum(1), 1)


def test_general_effects_equal_the_linear_ones(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=500)
    x = z + rng.normal(size=500)
    y = 2 * x - z + 0.1 * rng.normal(size=500)
    panel = Panel.from_arrays(spark, np.stack([x, y, z], axis=1))
    g = marks({(0, 1): "-->", (2, 0): "-->", (2, 1): "-->"}, 3)
    e = GeneralEffects(g, [(0, 0)], [(1, 0)]).fit(panel)
    got = {r["case"]: r["y0"] for r in e.predict([[0.0], [1.0]]).collect()}
    assert e.z == [(2, 0)] and got[1] - got[0] == pytest.approx(2, abs=0.02) and got[0] == pytest.approx(-z.mean(), abs=0.02)
    soft = e.predict([[0.5]], soft=True).first()["y0"]
    assert soft == pytest.approx((2 * (x + 0.5) - z).mean(), abs=0.02)
    # given S = z: E[y | do(x), z]
    given = GeneralEffects(marks({(0, 1): "-->", (2, 1): "-->"}, 3), [(0, 0)], [(1, 0)], s=[(2, 0)]).fit(panel, adjust=[]).predict([[1.0]], given=[[3.0]]).first()["y0"]
    assert given == pytest.approx(2 - 3, abs=0.1)


def test_natural_effects_against_the_truth(spark):
    """Triangle X -> M -> Y, X -> Y with an interaction, against worlds that share their noise."""
    model = C.Model({"x": lambda v: v.noise, "m": lambda v: 0.8 * v["x"] + v.noise, "y": lambda v: 1.5 * v["x"] + v["x"] * v["m"] + 0.7 * v["m"] + v.noise})
    df = model.world(model.noise(spark, 4000, 5))
    v = np.array(df.select("x", "y", "m").collect(), float)
    direct = C.natural_direct_effect(model, spark, "x", "y", ["m"], 0.0, 1.0, 50_000)
    indirect = C.natural_indirect_effect(model, spark, "x", "y", ["m"], 0.0, 1.0, 50_000)
    assert direct == pytest.approx(1.5, abs=0.03) and indirect == pytest.approx(0.56, abs=0.03)
    e = NaturalEffects(v, 1, [False, False, False], lambda: Nearest(150))
    assert e.direct(0.0, 1.0) == pytest.approx(direct, abs=0.25) and e.indirect(0.0, 1.0) == pytest.approx(indirect, abs=0.25)
    panel = Panel.from_arrays(spark, v[:, [0, 2, 1]])
    g = marks({(0, 1): "-->", (0, 2): "-->", (1, 2): "-->"}, 3)
    again = natural_effects(panel, g, (0, 0), (2, 0), lambda: Nearest(150))
    assert again.direct(0.0, 1.0) == pytest.approx(e.direct(0.0, 1.0), abs=1e-6) and mediation_set(g, (0, 0), (2, 0)) == ([(1, 0)], [])
    with pytest.raises(ValueError):
        mediation_set(marks({(0, 1): "-->"}, 2), (0, 0), (1, 0))
    at, effect = e.smoothed(-0.5, 0.5, 0.5, steps=4, sigma=2)
    assert len(at) == 4 and np.isfinite(effect).all()


def test_natural_effects_of_categories():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 6000).astype(float)
    m = (rng.random(6000) < 0.3 + 0.4 * x).astype(float)
    y = (rng.random(6000) < 0.1 + 0.3 * x + 0.4 * m).astype(float)
    e = NaturalEffects(np.column_stack([x, y, m]), 1, [True, True, True])
    changed, base = e.direct(0.0, 1.0)
    assert np.allclose(changed.sum(), 1) and changed[1] - base[1] == pytest.approx(0.3, abs=0.04)
    changed, base = e.indirect(0.0, 1.0)
    assert changed[1] - base[1] == pytest.approx(0.16, abs=0.04)


def test_smoothing_keeps_what_is_straight():
    at, out = smoothed_curve(lambda p: 3 * np.ones(len(p)), 0.0, 1.0, 10, 4)
    assert len(at) == 10 and np.allclose(out, 3, atol=0.02) and at[0] == 0.0


# -- worlds


def test_worlds(spark):
    m = C.Model({"a": lambda v: v.noise, "b": lambda v: 2 * v["a"] + v.noise})
    given = m.noise(spark, 50, 3)
    rows = m.intervened({"a": 1.0}).world(given).collect()
    assert all(r["a"] == 1.0 and r["b"] == pytest.approx(2 + r["noise_b"]) for r in rows)
    assert m.intervened({"b": lambda v: v["a"]}).world(given).where("a <> b").count() == 0
    assert m.links() == {0: [], 1: [(0, 0)]}
    with pytest.raises(ValueError):
        C.Model({"b": lambda v: v["a"], "a": lambda v: v.noise})
    s = C.Model({"x": lambda v: 0.5 * v["x", -1] + v.noise}, steps=4)
    row = s.world(s.noise(spark, 1, 1)).first()
    x = 0.0
    for t in range(4):
        x = 0.5 * x + row[f"noise_x__{t}"]
        assert row[f"x__{t}"] == pytest.approx(x)
    assert s.parents() == {"x": [("x", -1)]} and C.category_shares(m.intervened({"a": 1.0}).world(given), "a", [0, 1]).tolist() == [0, 1]
    assert C.direct_effect_curve(m, spark, "a", "b", [], [0.0, 2.0], 0.5, 100) == pytest.approx([1.0, 1.0])


# -- graphs


def test_canonical_graph():
    assert canonical(marks({(0, 1): "+->", (1, 2): "<->"}, 3)) == {0: [(3, 0)], 1: [(0, 0), (3, 0), (4, 0)], 2: [(4, 0)], 3: [], 4: []}
    assert canonical(from_links({0: [(0, -1)], 1: [(0, 0)]})) == {0: [(0, -1)], 1: [(0, 0)]}
    assert relevant_lag(from_links({0: [(0, -2)], 1: [(0, -1)]}), [(1, 0)]) == 3


def test_visible_links():
    g = TimeGraph(marks({(0, 1): "-->", (2, 0): "<->"}, 3), 0)
    assert g.visible((0, 0), (1, 0)) and g.amenable([(0, 0)], [(1, 0)])
    # v is a neighbour of y too
    assert not TimeGraph(marks({(0, 1): "-->", (2, 0): "<->", (2, 1): "-->"}, 3), 0).visible((0, 0), (1, 0))
    # over a collider that is a parent of y
    assert TimeGraph(marks({(0, 1): "-->", (2, 0): "<->", (2, 1): "-->", (3, 2): "-->"}, 4), 0).visible((0, 0), (1, 0))
    assert TimeGraph(marks({(0, 1): "-->"}, 2), 0).amenable([(1, 0)], [(0, 0)])


def test_optimality():
    # X <-> Z <-> Y would be opened by Z: the empty set alone is valid
    assert Adjustment(marks({(0, 1): "-->", (2, 0): "<->", (2, 1): "<->"}, 3), [(0, 0)], [(1, 0)], horizon=0).has_one()
    a = Adjustment(marks({(0, 1): "-->", (2, 0): "-->", (2, 1): "-->"}, 3), [(0, 0)], [(1, 0)], horizon=0)
    assert a.has_one() and a.optimality() and a.optimal_parts() == ({(2, 0)}, set()) and a.relevant_ends() == ({(0, 0)}, {(1, 0)})


def test_directed_members():
    """Of random directed graphs' classes: no new collider, no cycle, the same skeleton."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = 5
        order = rng.permutation(n)
        dag = np.zeros((n, n), bool)
        for a in range(n):
            for b in range(a + 1, n):
                dag[order[a], order[b]] = rng.random() < 0.5

        def heads(d):
            return {(i, k, j) for k in range(n) for i in range(n) for j in range(i) if d[i, k] and d[j, k] and not (d | d.T)[i, j]}

        g = marks({(int(i), int(j)): "o-o" for i, j in zip(*np.nonzero(dag))}, n)
        keep = {(i, k) for i, k, j in heads(dag)} | {(j, k) for i, k, j in heads(dag)}
        for i, k in keep:
            g[i, k, 0], g[k, i, 0] = "-->", "<--"
        search = Discovery(Panel(None, list("abcde")))
        found = type("F", (), {"graph": g, "ambiguous": []})()
        search.apply_rules(found, False)
        out = directed_member(found.graph)[:, :, 0] == "-->"
        assert ((out | out.T) == (dag | dag.T)).all() and not (out & out.T).any() and heads(out) == heads(dag)
        left = set(range(n))
        while left:
            free = [j for j in left if not any(out[i, j] for i in left)]
            assert free
            left -= set(free)


# -- generators


def test_var_process():
    links = {0: [((0, -1), 0.5, None)], 1: [((0, -1), 0.4, None), ((1, -2), 0.3, None)]}
    c = np.array([[1.0, 0.6], [0.6, 1.0]])
    x = var_process(links, 20_000, c, seed=1)
    r = x[2:] - np.stack([0.5 * x[1:-1, 0], 0.4 * x[1:-1, 0] + 0.3 * x[:-2, 1]], axis=1)
    assert np.allclose(np.cov(r.T), c, atol=0.05) and parents_of_links(links)[1] == [(0, -1), (1, -2)]
    y = var_process(links, 20_000, np.array([[1.0, 0.4], [0.4, 1.0]]), inverse=True, seed=1)
    r = y[2:] - np.stack([0.5 * y[1:-1, 0], 0.4 * y[1:-1, 0] + 0.3 * y[:-2, 1]], axis=1)
    assert np.allclose(np.linalg.inv(np.cov(r.T)), [[1, -0.4], [-0.4, 1]], atol=0.05)
    for bad in ({0: [((0, -1), 1.1, None)]}, {0: [], 1: [((0, 0), 0.5, None)]}):
        with pytest.raises(ValueError):
            var_process(bad, 10)
    assert (var_process(links, 5, initial=np.full((2, 2), 7.0))[:2] == 7).all()


def test_random_models():
    links = random_links(4, 4, 2, seed=2, functions=NONLINEAR)
    x, bad = structural_process(links, 300, 1, random_noises(4, ("uniform", "weibull"), seed=3))
    assert not bad and x.shape == (300, 4) and sum(len(p) - 1 for p in links.values()) >= 1


def test_surrogates_from_residuals():
    class Model:
        n, tau_max, base = 1, 1, [0.0]

        def tensor(self):
            return np.array([[[0.0]], [[0.5]]])

    x = surrogates(Model(), None, 50, 0, residuals=np.array([[1.0], [-1.0]]), block=2)
    assert set(np.round(x[1:, 0] - 0.5 * x[:-1, 0], 9)) <= {1.0, -1.0}


def test_context_model_refuses_mixed_context(spark):
    with pytest.raises(ValueError):
        context_model(spark, {0: [], 1: [((0, 0), 1.0, None)]}, {1: "time_context"}, 2, 10)


# -- files and panels


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head\n# note\n1950 1.0 2.0\n1951 3.0 -99\n")
    p = read_text(spark, str(tmp_path / "a.txt"), ["x", "y"], skip=1, missing_flag=-99, first_column=1)
    assert [tuple(r) for r in p.df.orderBy("t").select("t", "v0", "v1").collect()] == [(0, 1.0, 2.0), (1, 3.0, None)]
    np.save(tmp_path / "b.npy", np.arange(6.0).reshape(3, 2))
    assert read_npy(spark, str(tmp_path / "b.npy")).df.count() == 3
    write_null_distribution(spark, str(tmp_path / "n"), {100: np.array([3.0, 1.0])})
    assert read_null_distribution(spark, str(tmp_path / "n"))[100].tolist() == [1.0, 3.0]
    d = {r["variable"]: r for r in described(p).collect()}
    assert d["y"]["missing"] == 1 and d["x"]["mean"] == 2.0
    x = structural_process({0: [((0, -1), 0.7, None)], 1: [((0, -1), 0.7, None)]}, 400, seed=1)[0]
    found = Discovery(Panel.from_arrays(spark, x)).run_pcmci(1, alpha=0.001, conf=0.9)
    assert "(a -1) -->" in printed(found, ["a", "b"]) and "interval" in printed(found)


def test_spines_follow_the_data(spark):
    """Late, early and missing days are all there."""
    df = spark.createDataFrame([(5, 1.0), (9, 2.0), (None, 3.0)], "at long, x double")
    assert [(r["t"], r["x"]) for r in on_spine(df).orderBy("t").collect()] == [(0, 1.0), (1, None), (2, None), (3, None), (4, 2.0)]
    by = spark.createDataFrame([("a", 1, 1.0), ("b", 3, 2.0)], "k string, at long, x double")
    assert on_spine(by, ["k"]).count() == 6 and on_spine(df.limit(0)).count() == 0


# -- long series


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 1)).cumsum(0)
    df = Panel.from_arrays(spark, x).df
    want = {r["lag"]: r["r"] for r in T.autocorrelation(df, "v0", 9).collect()}
    smooth = {r["t"]: r["smoothed"] for r in T.smooth(df, "v0", 7).collect()}
    assert want[3] == pytest.approx(np.corrcoef(x[3:, 0], x[:-3, 0])[0, 1])
    assert smooth[300] == pytest.approx(x[297:304, 0].mean()) and smooth[0] == pytest.approx(x[:4, 0].mean()) and len(smooth) == 600
    original = T.overlapping
    monkeypatch.setattr(T, "overlapping", lambda df, before, after=0, block=0: original(df, before, after, 64))
    assert {r["lag"]: pytest.approx(r["r"]) for r in T.autocorrelation(df, "v0", 9).collect()} == want
    assert {r["t"]: pytest.approx(r["smoothed"]) for r in T.smooth(df, "v0", 7).collect()} == smooth
    assert [r["pos"] for r in numbered(df.where("t % 3 <> 0"), 50).orderBy("t").collect()] == list(range(400))


def test_gaussian_smoothing_reaches_far(spark):
    """A time whose values within nine widths are all missing gets the weighted mean of what is further away."""
    df = spark.createDataFrame([("0", t, float(t) if t < 3 or t > 60 else None) for t in range(70)], "dataset string, t long, v double")
    got = {r["t"]: r["smoothed"] for r in T.smooth(df, "v", 2, "gaussian").collect()}
    at = np.array([t for t in range(70) if t < 3 or t > 60], float)
    for t in (25, 31, 33, 1):
        w = -((t - at) ** 2) / 4
        w = np.exp(w - w.max())
        assert got[t] == pytest.approx((w * at).sum() / w.sum(), rel=1e-9)


def test_weighted_bootstrap_equals_copied_rows(spark):
    from lagweave.plans.pcmci import resampled

    rng = np.random.default_rng(8)
    panel = Panel.from_arrays(spark, {"a": rng.normal(size=(90, 2)), "b": rng.normal(size=(70, 2))})
    nodes = [(0, 0), (0, -1), (1, 0)]
    df = lagged(panel, nodes, 1)
    fast = resampled_moments(df, nodes, 4, 7, seed=3, chunk=32)
    slow = moments(resampled(df, 4, 7, 3), nodes, ["run"])
    assert sorted(fast) == [k for (k,) in sorted(slow)]
    for k, m in fast.items():
        assert m.n == slow[k,].n == 158 and np.allclose(m.mean, slow[k,].mean) and np.allclose(m.cov, slow[k,].cov)


def test_moments_by_key(spark):
    rng = np.random.default_rng(9)
    panel = Panel.from_arrays(spark, rng.normal(size=(60, 2)))
    df = lagged(panel, [(0, 0), (1, 0)], 0).withColumn("a", F.col("t") % 2).withColumn("b", F.floor(F.col("t") / 30))
    got = moments(df, [(0, 0), (1, 0)], ["a", "b"])
    assert len(got) == 4 and all(m.n == 15 for m in got.values())
    x = np.array(df.where("a = 1 and b = 0").select("x0_0", "x1_0").collect(), float)
    assert np.allclose(got["1", "0"].cov, np.cov(x.T, bias=True))
