"""Discovery against plain loops over arrays: one question after another, residuals by least squares."""

from itertools import combinations, product

import numpy as np
import pytest

from lagweave.functions.special import t_sf
from lagweave.plans.pcmci import Discovery
from lagweave.sources.panel import Panel
from lagweave.sources.processes import structural_process

LINKS = {0: [((0, -1), 0.6, None)], 1: [((1, -1), 0.5, None), ((0, -1), 0.5, None)], 2: [((2, -1), 0.4, None), ((1, 0), 0.6, None), ((0, -2), 0.3, None)], 3: [((3, -1), 0.5, None), ((2, 0), -0.5, None)]}


class Plain:
    def __init__(self, x, tau_max, first=None):
        self.x, self.tau_max, self.first = x, tau_max, 2 * tau_max if first is None else first

    def column(self, node):
        v, lag = node
        return self.x[self.first + lag : len(self.x) + lag, v]

    def test(self, x, y, z):
        given = np.stack([np.ones(len(self.x) - self.first), *(self.column(n) for n in z)], axis=1)
        a, b = (c - given @ np.linalg.lstsq(given, c, rcond=None)[0] for c in (self.column(x), self.column(y)))
        r = float(a @ b / np.sqrt((a @ a) * (b @ b)))
        df = len(a) - 2 - len(z)
        return r, 2 * t_sf(abs(r) * np.sqrt(df / (1 - r * r)), df)

    def parents(self, j, alpha):
        left = [(i, -t) for i in range(self.x.shape[1]) for t in range(1, self.tau_max + 1)]
        least, dim = {n: np.inf for n in left}, 0
        while len(left) - 1 >= dim:
            gone = []
            for n in left:
                z = [m for m in left if m != n][:dim]
                r, p = self.test(n, (j, 0), z)
                least[n] = min(least[n], abs(r))
                if p > alpha:
                    gone.append(n)
            left = sorted((n for n in left if n not in gone), key=lambda n: -least[n])
            dim += 1
        return left

    def momentary(self, parents):
        out = {}
        n = self.x.shape[1]
        for j, i, t in product(range(n), range(n), range(self.tau_max + 1)):
            if (i, t) == (j, 0):
                continue
            z = [m for m in parents[j] if m != (i, -t)] + [(k, s - t) for k, s in parents[i]]
            z = [m for m in dict.fromkeys(z) if m not in ((i, -t), (j, 0))]
            out[i, j, t] = self.test((i, -t), (j, 0), z)
        for i, j in combinations(range(n), 2):
            out[i, j, 0] = out[j, i, 0] = max(out[i, j, 0], out[j, i, 0], key=lambda a: a[1])
        return out


@pytest.fixture(scope="module")
def x():
    return structural_process(LINKS, 400, seed=8)[0]


def same(found, want):
    for (i, j, t), (r, p) in want.items():
        assert found.val[i, j, t] == pytest.approx(r, abs=1e-9) and found.p[i, j, t] == pytest.approx(p, abs=1e-9)


def test_pcmci(spark, x):
    plain = Plain(x, 2)
    parents = {j: plain.parents(j, 0.2) for j in range(4)}
    found = Discovery(Panel.from_arrays(spark, x)).run_pcmci(2, pc_alpha=0.2, alpha=0.01)
    assert {j: list(p) for j, p in found.parents.items()} == parents
    want = plain.momentary(parents)
    same(found, want)
    for (i, j, t), (_, p) in want.items():
        assert found.graph[i, j, t] == ("" if p > 0.01 else "-->" if t else "o-o")


def test_alpha_grid_takes_the_best_model(spark, x):
    plain, grid = Plain(x, 1), (0.01, 0.2)
    n = len(x) - 2

    def score(j, parents):
        given = np.stack([np.ones(n), *(plain.column(m) for m in parents)], axis=1)
        y = plain.column((j, 0))
        e = y - given @ np.linalg.lstsq(given, y, rcond=None)[0]
        return n * np.log(n * (e @ e / n) / y.var()) + 2 * len(parents)

    found = Discovery(Panel.from_arrays(spark, x)).run_pcmci(1, pc_alpha=list(grid))
    for j in range(4):
        assert list(found.parents[j]) == min((plain.parents(j, a) for a in grid), key=lambda ps: score(j, ps))


def test_sliding_windows(spark, x):
    runs = Discovery(Panel.from_arrays(spark, x)).windows("run_pcmci", 150, 200, tau_max=1, pc_alpha=0.2, alpha=0.01)
    assert sorted(runs, key=int) == ["0", "1"]
    for k, start in (("0", 0), ("1", 150)):
        # anchor times of the window; lags may reach before it
        plain = Plain(x[: start + 200], 1, first=max(2, start))
        same(runs[k], plain.momentary({j: plain.parents(j, 0.2) for j in range(4)}))


def test_pcmciplus_skeleton(spark, x):
    """Every link that is left depends given every set it was tested with; every link that went is separated by the kept set."""
    plain = Plain(x, 2)
    found = Discovery(Panel.from_arrays(spark, x)).run_pcmciplus(2, pc_alpha=0.01)
    parents = found.parents
    assert parents == {j: plain.parents(j, 0.01) for j in range(4)}
    for i, j, t in product(range(4), range(4), range(3)):
        if (i, t) == (j, 0) or (t and (i, -t) not in parents[j]):
            continue
        z = lambda s: [m for m in dict.fromkeys([*s, *[q for q in parents[j] if q != (i, -t)], *[(k, lag - t) for k, lag in parents[i]]]) if m not in ((i, -t), (j, 0))]  # noqa: B023, E731
        if found.graph[i, j, t] == "":
            kept = found.sepsets.get(((i, -t), j))
            r, p = plain.test((i, -t), (j, 0), z(kept))
            back = plain.test((j, 0), (i, 0), [m for m in dict.fromkeys([*found.sepsets[(j, 0), i], *parents[i], *parents[j]]) if m not in ((j, 0), (i, 0))])[1] if t == 0 else 0
            assert max(p, back) > 0.01
        else:
            assert plain.test((i, -t), (j, 0), z(()))[1] <= 0.01
    present = {(int(i), int(j), int(t)) for i, j, t in zip(*np.nonzero(found.graph == "-->"))}
    assert {(0, 1, 1), (2, 3, 0), (1, 2, 0)} <= present


def test_false_discovery_over_chosen_links(spark, x):
    d = Discovery(Panel.from_arrays(spark, x))
    plain = d.momentary(1)
    for lag0, counted in ((False, [(i, j, 1) for i in range(4) for j in range(4)]), (True, [(i, j, t) for i in range(4) for j in range(4) for t in (0, 1) if (i, t) != (j, 0)])):
        got = d.momentary(1, fdr=True, fdr_contemporaneous=lag0)
        raw = {}
        for i, j, t in counted:
            raw[i, j, t] = plain.p[i, j, t]
        order = sorted(raw, key=raw.get)
        q, low = {}, 1.0
        for k in range(len(order), 0, -1):
            low = min(low, raw[order[k - 1]] * len(order) / k)
            q[order[k - 1]] = low
        for (i, j, t), v in q.items():
            if t:
                assert got.p[i, j, t] == pytest.approx(v)
