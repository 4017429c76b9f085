"""Shuffled, thresholded and bootstrapped tests, mixed data, weights, and the numbers behind p values."""

import numpy as np
import pytest

from lagweave.functions.special import chi2_sf, t_sf
from lagweave.functions.transforms import block_length
from lagweave.operators.ci import CMIknn, CMIsymb, Data, GPDC, GSquared, ParCorr, ParCorrMult, ParCorrWLS, Question, RobustParCorr, cmi, shuffled_table, table_cmi
from lagweave.operators.mixed import CMIknnMixed, RegressionCI, encoded, logistic_deviance
from lagweave.operators.significance import Bootstrapped, Shuffled, Thresholded, drawn_blocks, measure_raw, run_test, run_test_raw, series_block, shuffled_blocks
from lagweave.sources.panel import Panel


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(1)
    z = rng.normal(size=300)
    return z + rng.normal(size=300), z + rng.normal(size=300), z


def test_tails_have_known_values():
    # Quantiles of printed tables.
    assert np.allclose([t_sf(2.228139, 10), t_sf(1.644854, 1e7), t_sf(12.7062, 1)], [0.025, 0.05, 0.025], atol=1e-6)
    assert np.allclose([chi2_sf(3.841459, 1), chi2_sf(18.307038, 10), chi2_sf(11.344867, 3)], [0.05, 0.05, 0.01], atol=1e-6)


def test_shuffle_agrees_with_the_analytic_p(pair):
    x, y, z = pair
    val, p, dependent = run_test_raw(Shuffled(ParCorr(), 2000, block=1), x, y, z, alpha=0.05)
    want, q, _ = run_test_raw(ParCorr(), x, y, z)
    assert val == pytest.approx(want) and abs(p - q) < 0.04 and not dependent
    assert run_test_raw(Shuffled(ParCorr(), 200), x, y, alpha=0.05)[2]


def test_blocks():
    rng = np.random.default_rng(0)
    for n, b in ((10, 3), (7, 7), (5, 9), (12, 1)):
        assert sorted(shuffled_blocks(n, b, rng)) == list(range(n))
        at = drawn_blocks(n, min(b, n), rng)
        assert len(at) == n and at.max() < n
    assert series_block(np.cumsum(rng.normal(size=500))) > series_block(rng.normal(size=500))
    assert series_block(np.zeros(100)) == 1
    assert block_length(np.full(20, np.nan), 400) == 20


def test_thresholds_and_intervals(spark, pair):
    x, y, z = pair
    data = Data(Panel.from_arrays(spark, np.stack([x, y, z], axis=1)), 0)
    q = [Question(((0, 0),), ((1, 0),)), Question(((0, 0),), ((1, 0),), ((2, 0),))]
    assert [a.p for a in Thresholded(ParCorr(), 0.3).run(data, q)] == [0.0, 1.0]
    a = Bootstrapped(ParCorr(), 0.9, 300, block=1).run(data, q[:1])[0]
    low, high = ParCorr.confidence(a.val, a.n, a.dim, 0.9)
    assert abs(a.conf[0] - low) < 0.04 and abs(a.conf[1] - high) < 0.04
    val, p, dependent = run_test(ParCorr(), data, q[0].x, q[0].y, alpha=0.01)
    assert dependent and val == pytest.approx(measure_raw(ParCorr(), x, y))


def test_values_on_arrays_equal_those_on_moments(spark, pair):
    x, y, z = pair
    rng = np.random.default_rng(3)
    v = np.stack([x, y, z, rng.normal(size=300) + x], axis=1)
    data = Data(Panel.from_arrays(spark, v), 0)
    for measure in ("max_corr", "wilks"):
        t = ParCorrMult(measure)
        a = t.run(data, [Question(((0, 0), (1, 0)), ((3, 0),), ((2, 0),))])[0]
        assert a.val == pytest.approx(measure_raw(t, v[:, :2], v[:, 3], v[:, 2]))


def test_permuted_tables_keep_margins():
    rng = np.random.default_rng(4)
    x, y, z = rng.integers(0, 3, (3, 400))
    table = np.zeros((3, 3, 3), int)
    np.add.at(table, (z, x, y), 1)
    assert table_cmi(table) == pytest.approx(cmi(x, y, z))
    t = shuffled_table(table, rng)
    assert (t.sum(2) == table.sum(2)).all() and (t.sum(1) == table.sum(1)).all()


def test_contingency_p_against_brute_force(spark):
    rng = np.random.default_rng(5)
    z = rng.integers(0, 2, 400)
    x, y = (z + rng.integers(0, 2, 400)) % 2, (z + rng.integers(0, 3, 400)) % 3
    data = Data(Panel.from_arrays(spark, np.stack([x, y, z], axis=1).astype(float)), 0)
    q = Question(((0, 0),), ((1, 0),), ((2, 0),))
    g = dof = 0.0
    for s in (0, 1):
        t = np.zeros((2, 3))
        np.add.at(t, (x[z == s], y[z == s]), 1)
        e = t.sum(1)[:, None] * t.sum(0)[None] / t.sum()
        g += 2 * (t[t > 0] * np.log(t[t > 0] / e[t > 0])).sum()
        dof += 2
    both = GSquared().run(data, [q, Question(((0, 0),), ((1, 0),), ((2, 0),))])
    for a in both:
        assert a.val == pytest.approx(g) and a.p == pytest.approx(chi2_sf(g, dof))
    a = CMIsymb(300).run(data, [q])[0]
    null = np.array([cmi(np.concatenate([rng.permutation(x[z == s]) for s in (0, 1)]), np.concatenate([y[z == s] for s in (0, 1)]), np.sort(z)) for _ in range(300)])
    assert a.val == pytest.approx(cmi(x, y, z)) and abs(a.p - (null >= a.val).mean()) < 0.15


def test_regression_test_of_all_kinds(pair):
    x, y, z = pair
    rng = np.random.default_rng(6)
    a = RegressionCI().raw(x, y, z)
    r = measure_raw(ParCorr(), x, y, z)
    assert a.val == pytest.approx(-300 * np.log(1 - r * r)) and a.p == pytest.approx(chi2_sf(a.val, 1))
    flag = (x + rng.normal(size=300) > 0).astype(float)
    number, none = np.zeros(1, bool), np.zeros(0, bool)
    linked = RegressionCI().raw(flag, x, kinds=(~number, number, none))
    other = RegressionCI().raw(x, flag, kinds=(number, ~number, none))
    assert linked.val == pytest.approx(other.val) and linked.p < 1e-6
    assert RegressionCI().raw(flag, rng.normal(size=300), kinds=(~number, number, none)).p > 0.01
    three = rng.integers(0, 3, 300).astype(float)
    assert RegressionCI().raw(flag, three, kinds=(~number, ~number, none)).p > 0.01
    assert RegressionCI().raw(flag, np.where(flag > 0, three, 0.0), z, kinds=(~number, ~number, number)).p < 0.01
    with pytest.raises(ValueError):
        RegressionCI().raw(np.stack([flag, x], axis=1), y, kinds=(np.array([True, False]), number, none))


def test_logistic_deviance_is_least(pair):
    x, _, z = pair
    target = np.digitize(x, [-0.5, 0.7]).astype(float)
    v = np.stack([z, z * z], axis=1)
    best = logistic_deviance(v, target, penalty=1e-9)
    rng = np.random.default_rng(7)
    w = np.concatenate([np.ones((300, 1)), v], axis=1)
    for _ in range(30):
        s = w @ rng.normal(0, 1, (3, 3))
        s = s - np.log(np.exp(s).sum(1, keepdims=True))
        assert best <= -2 * s[np.arange(300), target.astype(int)].sum() + 1e-6
    assert encoded(np.array([[1.0, 5.0], [2.0, 6.0]]), np.array([True, False])).tolist() == [[1, 0, 5], [0, 1, 6]]


@pytest.mark.parametrize("estimator", ["MS", "MSinf", "ZMADG"])
def test_mixed_neighbours(estimator):
    rng = np.random.default_rng(8)
    c = rng.integers(0, 2, 300).astype(float)
    x = 2.0 * c + rng.normal(size=300)
    yes, no, none = np.ones(1, bool), np.zeros(1, bool), np.zeros(0, bool)
    t = CMIknnMixed(5 if estimator != "MS" else 0.1, estimator, samples=40)
    linked, apart = t.raw(c, x, kinds=(yes, no, none)), t.raw(c, rng.normal(size=300), kinds=(yes, no, none))
    assert linked.val > 0.15 and linked.p < 0.05 < apart.p and abs(apart.val) < 0.1
    given = t.raw(c, x + rng.normal(size=300), x, kinds=(yes, no, no))
    assert given.val < linked.val


def test_conditional_entropy_of_normals():
    rng = np.random.default_rng(9)
    z = rng.normal(size=2000)
    x = z + 0.5 * rng.normal(size=2000)
    got = CMIknn(knn=5, transform="none").conditional_entropy(x, z)
    assert abs(got - 0.5 * np.log(2 * np.pi * np.e * 0.25)) < 0.15


def test_weights():
    rng = np.random.default_rng(10)
    z = rng.normal(size=500)
    spread = 1 + 4 * (z > 0)
    x, y = z + spread * rng.normal(size=500), z + spread * rng.normal(size=500)
    known = ParCorrWLS(known=(spread, spread)).raw(x, y, z)
    parent, time = ParCorrWLS(expert=0).raw(x, y, z), ParCorrWLS().raw(x, y, z)
    assert max(abs(known.val), abs(parent.val), abs(time.val)) < 0.2
    # with weights of one it is the plain test
    assert ParCorrWLS(known=(np.ones(500), np.ones(500))).raw(x, y, z).val == pytest.approx(measure_raw(ParCorr(), x, y, z), abs=2e-3)
    assert ParCorrWLS(expert=(None, "time"), robust=True).raw(x, y, z).p > 1e-3


def test_every_test_has_a_value_on_arrays(pair):
    x, y, z = (v[:120] for v in pair)
    for t in (ParCorr(), RobustParCorr(), ParCorrWLS(), GPDC(20)):
        assert abs(measure_raw(t, x, y)) > abs(measure_raw(t, x, np.random.default_rng(0).normal(size=120)))
