"""Discovery with hidden variables, on exact answers of known models."""

from itertools import permutations

import numpy as np
import pytest

from lagweave.operators.ci import OracleCI
from lagweave.plans.lpcmci import LatentDiscovery, Marks, matches
from lagweave.sources.panel import Panel
from lagweave.sources.processes import structural_process


def run(model, observed, tau_max, **args):
    return LatentDiscovery(Panel(None, [str(i) for i in observed]), OracleCI(model, observed)).run_lpcmci(tau_max, **args)


def present(graph):
    return {(int(i), int(j), int(t)): str(graph[i, j, t]) for i, j, t in zip(*np.nonzero(graph != "")) if t or i < j}


def test_hidden_cause_of_two():
    found = run({0: [(0, -1), (2, 0)], 1: [(1, -1), (2, 0)], 2: []}, [0, 1], 1)
    assert present(found.graph) == {(0, 0, 1): "-->", (1, 1, 1): "-->", (0, 1, 0): "<->"}


def test_hidden_cause_at_a_lag():
    found = run({0: [(0, -1), (2, -1)], 1: [(1, -1), (2, 0)], 2: []}, [0, 1], 2)
    assert present(found.graph) == {(0, 0, 1): "-->", (1, 1, 1): "-->", (1, 0, 1): "<->"}


def test_chain_without_hidden_causes():
    found = run({0: [(0, -1)], 1: [(1, -1), (0, 0)], 2: [(2, -1), (1, 0)]}, [0, 1, 2], 2)
    assert present(found.graph) == {(0, 0, 1): "-->", (0, 1, 0): "-->", (1, 1, 1): "-->", (1, 2, 0): "-->", (2, 2, 1): "-->"}


def test_mixture_of_both():
    links = {0: [(0, -1), (4, -1)], 1: [(1, -1), (0, -1)], 2: [(2, -1), (1, 0), (3, 0)], 3: [(3, -1), (4, 0)], 4: []}
    found = run(links, [0, 1, 2, 3], 2)
    want = {(k, k, 1): "-->" for k in range(4)} | {(0, 1, 1): "-->", (1, 2, 0): "-->", (2, 3, 0): "<--", (3, 0, 1): "<->"}
    assert present(found.graph) == want


def test_no_direction_without_evidence():
    """Two variables linked at lag 0 without a past: nothing tells the ends."""
    assert present(run({0: [], 1: [(0, 0)]}, [0, 1], 0).graph) == {(0, 1, 0): "o-o"}


def test_collider_without_time():
    found = run({0: [], 1: [], 2: [(0, 0), (1, 0)]}, [0, 1, 2], 0)
    assert present(found.graph) == {(0, 2, 0): "o->", (1, 2, 0): "o->"}


def test_marks_never_contradict_the_model():
    """On random models: a tail is a true ancestor, a head is none, and linked pairs are those that no set separates."""
    rng = np.random.default_rng(3)
    for _ in range(12):
        n = 4
        links = {j: [(j, -1)] if rng.random() < 0.7 else [] for j in range(n)}
        for i in range(n):
            for j in range(n):
                if i < j and rng.random() < 0.4:
                    links[j].append((i, 0))
                elif i != j and rng.random() < 0.2:
                    links[j].append((i, -1))
        observed = [0, 1, 2]
        found = run(links, observed, 1)
        truth = OracleCI(links)

        def ancestor(a, b):
            seen, todo = set(), [b]
            while todo:
                v, t = todo.pop()
                if (v, t) == a:
                    return True
                if (v, t) not in seen and t >= a[1]:
                    seen.add((v, t))
                    todo += [(i, t + lag) for i, lag in truth.parents[v]]
            return False

        for (i, j, t), mark in present(found.graph).items():
            a, b = (observed[i], -t), (observed[j], 0)
            if mark[0] == "-":
                assert ancestor(a, b)
            if mark[0] == "<":
                assert not ancestor(a, b)
            if mark[2] == "-":
                assert ancestor(b, a)
            if mark[2] == ">":
                assert not ancestor(b, a)


def test_order_of_variables_does_not_matter():
    links = {0: [(0, -1), (3, 0)], 1: [(1, -1), (0, -1)], 2: [(2, -1), (1, 0), (3, 0)], 3: []}
    base = run(links, [0, 1, 2], 1).graph
    for order in permutations([0, 1, 2]):
        graph = run(links, list(order), 1).graph
        at = [order.index(k) for k in range(3)]
        assert (graph[np.ix_(at, at, [0, 1])] == base).all()


def test_assumed_links_and_limits():
    links = {0: [(0, -1), (2, 0)], 1: [(1, -1), (2, 0)], 2: []}
    assert (0, 1, 0) not in present(run(links, [0, 1], 1, links={0: {(1, 0): ""}, 1: {(0, 0): ""}}).graph)
    assert all(t >= 1 for _, _, t in present(run(links, [0, 1], 1, tau_min=1).graph))
    assert present(run(links, [0, 1], 1, preliminary=0, max_cond_px=1).graph)[0, 1, 0] == "<->"
    assert present(run(links, [0, 1], 1, only_preliminary=True, non_ancestral=False, auto_first=False, middle_marks=False).graph)[0, 1, 0][1] == "-"
    with pytest.raises(ValueError):
        run(links, [0, 1], 1, links={0: {(1, 1): "-->"}})


def test_claims_that_contradict_are_marked():
    g = Marks(2, 1)
    g.put((0, 0), (1, 0), "o-o")
    assert g.claim(set(), {((0, 0), (1, 0))}) and g.link((0, 0), (1, 0)) == "-->"
    assert not g.claim({((0, 0), (1, 0))}, set()) and g.link((0, 0), (1, 0)) == "x->"
    assert not g.claim(set(), {((0, 0), (1, 0))})
    assert matches("<-o", "+*o") and not matches("--o", "+*o") and matches("", "")


def test_on_data(spark):
    links = {0: [((0, -1), 0.6, None)], 1: [((1, -1), 0.6, None), ((0, 0), 0.8, None)]}
    x = structural_process(links, 1500, seed=4)[0]
    found = LatentDiscovery(Panel.from_arrays(spark, x)).run_lpcmci(2, pc_alpha=0.001)
    assert present(found.graph) == {(0, 0, 1): "-->", (1, 1, 1): "-->", (0, 1, 0): "-->"}
    assert found.p[0, 1, 0] < 0.001 and abs(found.val[0, 1, 0]) > 0.2
