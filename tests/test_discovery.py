import numpy as np
import pytest

from lagweave.operators import links as L
from lagweave.operators.ci import GPDC, CMIknn, CMIsymb, Data, GSquared, OracleCI, PairwiseMultCI, ParCorr, ParCorrMult, ParCorrWLS, Question, RobustParCorr, cmi, distance_correlation
from lagweave.plans.pcmci import Discovery, assumptions
from lagweave.sources.panel import Panel
from lagweave.sources.processes import structural_process

CHAIN = {0: [((0, -1), 0.5, None)], 1: [((1, -1), 0.5, None), ((0, -1), 0.6, None)], 2: [((2, -1), 0.5, None), ((1, -1), 0.6, None)]}
COLLIDER = {0: [((0, -1), 0.5, None)], 1: [((1, -1), 0.5, None), ((0, 0), 0.6, None), ((2, 0), 0.6, None)], 2: [((2, -1), 0.5, None)]}


@pytest.fixture(scope="module")
def chain():
    return structural_process(CHAIN, 1000, seed=2)[0]


def present(graph):
    return {(int(i), int(j), int(t)): str(graph[i, j, t]) for i, j, t in zip(*np.nonzero(graph != ""))}


def test_partial_correlation(spark, chain):
    q = Question(((0, -1),), ((1, 0),), ((1, -1), (2, -2)))
    a = ParCorr().run(Data(Panel.from_arrays(spark, chain), 2), [q])[0]
    x, y, z = chain[3:-1, 0], chain[4:, 1], np.stack([np.ones(996), chain[3:-1, 1], chain[2:-2, 2]], axis=1)
    rx, ry = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (x, y))
    assert np.isclose(a.val, np.corrcoef(rx, ry)[0, 1]) and a.n == 996 and a.p < 1e-10
    low, high = ParCorr.confidence(a.val, a.n, a.dim, 0.95)
    assert low < a.val < high


def test_masks_give_each_test_its_rows(spark, chain):
    mask = (np.random.default_rng(0).random(chain.shape) < 0.3).astype(int)
    q = Question(((0, -1),), ((1, 0),))
    a = ParCorr().run(Data(Panel.from_arrays(spark, chain, mask=mask), 1, mask_type="y"), [q])[0]
    keep = mask[2:, 1] == 0
    assert np.isclose(a.val, np.corrcoef(chain[1:-1, 0][keep], chain[2:, 1][keep])[0, 1]) and a.n == keep.sum()


@pytest.mark.parametrize("test", [RobustParCorr(), ParCorrWLS(), CMIknn(samples=30), GPDC(samples=30)])
def test_sample_tests_tell_links_apart(spark, chain, test):
    data = Data(Panel.from_arrays(spark, chain[:250]), 1)
    linked, apart = test.run(data, [Question(((0, -1),), ((1, 0),), ((1, -1),)), Question(((2, -1),), ((0, 0),), ((0, -1), (1, -1)))])
    assert linked.p < 0.05 < apart.p


def test_gpdc_null_has_the_size_of_the_sample():
    """p of independent samples is spread over 0..1; with a null of fewer rows it is near 1."""
    rng = np.random.default_rng(5)
    p = [GPDC(samples=40).raw(*rng.normal(size=(2, 4000))).p for _ in range(12)]
    assert 0.25 < np.mean(p) < 0.75 and min(p) < 0.35


def test_distance_correlation_in_blocks():
    x, y = np.random.default_rng(6).normal(size=(2, 1100))
    y = y + np.abs(x)
    a, b = (np.abs(v[:, None] - v[None]) for v in (x, y))
    a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (a, b))
    assert np.isclose(distance_correlation(x, y), np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean())), rtol=1e-9)


def test_multivariate(spark, chain):
    data = Data(Panel.from_arrays(spark, chain), 1)
    linked, apart = Question(((0, -1), (2, -1)), ((1, 0), (2, 0))), Question(((2, -1),), ((0, 0),), ((0, -1), (1, -1)))
    for test in (ParCorrMult(), ParCorrMult("wilks"), PairwiseMultCI()):
        a, b = test.run(data, [linked, apart])
        assert a.p < 1e-6 and b.p > 0.01


def test_discrete(spark):
    rng = np.random.default_rng(4)
    z = rng.integers(0, 3, 2000)
    x, y = (z + (rng.random((2, 2000)) < 0.5)) % 3
    data = Data(Panel.from_arrays(spark, np.stack([x, y, z], axis=1).astype(float)), 0)
    apart, linked = Question(((0, 0),), ((1, 0),), ((2, 0),)), Question(((0, 0),), ((1, 0),))
    for test in (CMIsymb(60), GSquared()):
        a, b = test.run(data, [apart, linked])
        assert a.p > 0.01 and b.p < 0.02
    assert np.isclose(CMIsymb(0).run(data, [apart])[0].val, cmi(x, y, z))


def test_oracle():
    o = OracleCI(CHAIN)
    ask = lambda *q: o.run(None, [Question(*q)])[0].val == 1.0
    assert ask(((0, -1),), ((2, 0),)) and not ask(((0, -2),), ((2, 0),), ((1, -1), (2, -1)))
    assert not OracleCI(COLLIDER).connected(Question(((0, 0),), ((2, 0),))) and OracleCI(COLLIDER).connected(Question(((0, 0),), ((2, 0),), ((1, 0),)))


def test_pcmci_finds_the_chain(spark, chain):
    found = Discovery(Panel.from_arrays(spark, chain)).run_pcmci(2, pc_alpha=0.1, alpha=0.001)
    assert present(found.graph) == {(0, 0, 1): "-->", (1, 1, 1): "-->", (2, 2, 1): "-->", (0, 1, 1): "-->", (1, 2, 1): "-->"}


@pytest.mark.parametrize("rule", ["majority", "conservative", "none"])
def test_pcmciplus_with_oracle(spark, chain, rule):
    found = Discovery(Panel.from_arrays(spark, chain[:30]), OracleCI(COLLIDER)).run_pcmciplus(2, pc_alpha=0.01, colliders=rule)
    assert present(found.graph) == {(0, 0, 1): "-->", (1, 1, 1): "-->", (2, 2, 1): "-->", (0, 1, 0): "-->", (1, 0, 0): "<--", (2, 1, 0): "-->", (1, 2, 0): "<--"}


def test_rules_orient_after_a_lagged_link(spark, chain):
    """0 acts on 1 with a lag, 1 on 2 at once: no other orientation leaves 0 and 2 unshielded."""
    links = {0: [((0, -1), 0.5, None)], 1: [((0, -1), 0.6, None)], 2: [((1, 0), 0.6, None)]}
    found = Discovery(Panel.from_arrays(spark, chain[:30]), OracleCI(links)).run_pcmciplus(1)
    assert found.graph[1, 2, 0] == "-->" and found.graph[2, 1, 0] == "<--"


def test_plain_pc(spark, chain):
    links = {0: [], 1: [((0, 0), 1, None), ((2, 0), 1, None)], 2: []}
    found = Discovery(Panel.from_arrays(spark, chain[:30]), OracleCI(links)).run_pc(0)
    assert present(found.graph) == {(0, 1, 0): "-->", (1, 0, 0): "<--", (2, 1, 0): "-->", (1, 2, 0): "<--"}


def test_windows_and_bootstrap(spark, chain):
    found = Discovery(Panel.from_arrays(spark, chain))
    windows = found.windows("run_pcmci", 250, 250, tau_max=1, alpha=0.001)
    assert list(windows) == ["0", "1", "2"] and all(f.graph[0, 1, 1] == "-->" for f in windows.values())
    runs = found.bootstrap("run_pcmci", tau_max=1, samples=6, block=3, alpha=0.001)
    got = {(r["i"], r["j"], r["tau"]): r for r in found.summarised(runs).collect()}
    assert got[0, 1, 1]["link"] == "-->" and got[0, 1, 1]["frequency"] == 1.0 and got[2, 0, 1]["link"] == ""
    again = found.bootstrap("run_pcmci", tau_max=1, samples=6, block=3, alpha=0.001)
    assert all(np.array_equal(runs[k].val, again[k].val) for k in runs)


def test_assumptions():
    assert assumptions(2, 0, 1)[0] == {(0, -1): "-?>", (1, 0): "o?o", (1, -1): "-?>"}
    assert assumptions(2, 0, 1, {0: {(1, 0): "-->"}})[1] == {(0, 0): "<--"}
    with pytest.raises(ValueError, match="differ"):
        assumptions(2, 0, 1, {0: {(1, 0): "-->"}, 1: {(0, 0): "-->"}})
    with pytest.raises(ValueError, match="cycle"):
        assumptions(3, 0, 1, {0: {(1, 0): "-->"}, 1: {(2, 0): "-->"}, 2: {(0, 0): "-->"}})


def test_fdr_table_equals_matrix(spark):
    p = np.random.default_rng(5).random((3, 3, 3)) ** 3
    counted = np.zeros(p.shape, bool)
    counted[:, :, 1:] = True
    want = L.fdr_values(p, counted)
    got = L.fdr(L.to_links(spark, p, p)).collect()
    assert all(np.isclose(r["q"], want[r["i"], r["j"], r["tau"]]) for r in got)


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0, 0.5, 0.1, "o-o"), (1, 0, 0, 0.5, 0.1, "o-o"), (0, 1, 2, 0.3, 0.1, "-->"), (0, 1, 1, 0.3, 0.1, "")], L.LINKS + ", link string")
    L.write_csv(df, str(tmp_path / "links"), ["a", "b"])
    got = spark.read.option("header", True).csv(str(tmp_path / "links"))
    assert sorted((r[0], r[1], r[2], r[3]) for r in got.collect()) == [("a", "b", "0", "o-o"), ("a", "b", "2", "-->")]
