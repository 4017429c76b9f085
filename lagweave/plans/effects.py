"""Causal effects from a graph and data: total effects by adjustment, path coefficients, interventions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators.ci import Data, Question
from lagweave.operators.embedding import Node, column, sample
from lagweave.operators.moments import resampled_moments
from lagweave.sources.panel import Panel

from .graphs import Adjustment
from .models import regression


class CausalEffects:
    def __init__(self, graph: np.ndarray, x: Iterable[Node], y: Iterable[Node], s: Iterable[Node] = (), hidden: Iterable[Node] = ()):
        self.adjustment = Adjustment(graph, x, y, s, hidden)
        self.x, self.y, self.s = list(x), list(y), list(s)

    def adjustment_set(self, given: Iterable[Node] | str = "optimal") -> list[Node]:
        z = {"optimal": self.adjustment.optimal, "minimized_optimal": lambda: self.adjustment.optimal(True)}[given]() if isinstance(given, str) else set(given)
        if z is None or not self.adjustment.valid(z):
            raise ValueError("the effect is not identified by such an adjustment set")
        return sorted(z)

    def fit(self, panel: Panel, adjust: Iterable[Node] | str = "optimal", tau_max: int | None = None) -> CausalEffects:
        """Linear models of Y on X, the adjustment set and S."""
        self.z = self.adjustment_set(adjust)
        nodes = [*self.x, *self.y, *self.z, *self.s]
        self.tau_max = max(-lag for _, lag in nodes) if tau_max is None else tau_max
        data = Data(panel, self.tau_max, "tau_max")
        m = data.moments([Question(tuple(self.x), tuple(self.y), tuple([*self.z, *self.s]))])[0]
        self.moments, self.models = m, {y: regression(m, y, [*self.x, *self.z, *self.s]) for y in self.y}
        return self

    def effect(self) -> dict[tuple[Node, Node], float]:
        """Linear effect of each X on each Y."""
        return {(x, y): float(self.models[y][0][k]) for y in self.y for k, x in enumerate(self.x)}

    def predict(self, panel: Panel, do: Sequence[Sequence[float]], soft: bool = False) -> DataFrame:
        """(case, y0..): mean of Y over the observed adjustment set, with X set to each case of `do`, or moved by it."""
        spark = panel.df.sparkSession
        obs = sample(panel, self.x, self.y, self.z, self.s, self.tau_max, "tau_max").df
        means = obs.agg(*[F.avg(column(n)).alias(column(n)) for n in [*self.x, *self.z, *self.s]])
        cases = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(do)], "case int, " + ", ".join(f"d{k} double" for k in range(len(self.x))))
        out = []
        for k, y in enumerate(self.y):
            coef, base = self.models[y]
            e = F.lit(base)
            for c, node in zip(coef[len(self.x) :], [*self.z, *self.s]):
                e = e + F.col(column(node)) * F.lit(float(c))
            for i, node in enumerate(self.x):
                e = e + (F.col(f"d{i}") + F.col(column(node)) if soft else F.col(f"d{i}")) * F.lit(float(coef[i]))
            out.append(e.alias(f"y{k}"))
        return cases.crossJoin(F.broadcast(means)).select("case", *out)  # one row of means

    def bootstrap(self, panel: Panel, samples: int = 100, block: int = 1, seed: int = 0, level: float = 0.9) -> dict[tuple[Node, Node], tuple[float, float]]:
        """Intervals of the linear effects, all samples in one grouped pass."""
        nodes = list(dict.fromkeys([*self.x, *self.y, *self.z, *self.s]))
        df = sample(panel, self.x, self.y, self.z, self.s, self.tau_max, "tau_max").df
        got = [m for _, m in sorted(resampled_moments(df, nodes, samples, block, seed).items())]
        out = {}
        for y in self.y:
            values = np.array([regression(m, y, [*self.x, *self.z, *self.s])[0][: len(self.x)] for m in got])
            for k, x in enumerate(self.x):
                out[x, y] = tuple(map(float, np.quantile(values[:, k], [(1 - level) / 2, (1 + level) / 2])))
        return out

    def wright(self, panel: Panel | None, through: Iterable[Node] | None = None, method: str = "parents", coefficients: dict[tuple[Node, Node], float] | None = None) -> dict[tuple[Node, Node], float]:
        """Effects as sums over directed paths of products of link coefficients: from the regression of a node on its parents; or, "optimal", each link's direct effect by an
        optimal adjustment set beside the node's other parents, for graphs with bidirected links too; or given ("links"), by (node, node) as on the paths."""
        g = self.adjustment.g
        paths = {(x, y): g.paths([x], [y], through) for x in self.x for y in self.y}
        links = sorted({(a, b) for ps in paths.values() for p in ps for a, b in zip(p, p[1:])})
        coef: dict[tuple[Node, Node], float] = {}
        if method == "links":
            shift = lambda a, b: ((a[0], a[1] - b[1]), (b[0], 0))
            given = {shift(a, b): c for (a, b), c in (coefficients or {}).items()}
            coef = {(a, b): given[shift(a, b)] for a, b in links}
        elif links and method in ("parents", "optimal"):
            data = Data(panel, max(-lag for a, b in links for _, lag in (a, b, *g.parents([b]))), "tau_max")
            for a, b in links:
                others = sorted(g.parents([b]) - {a})
                if method == "optimal":
                    own = Adjustment(g.graph, [a], [b], others, horizon=g.horizon)
                    extra = own.optimal()
                    if extra is None:
                        raise ValueError("the effect is not identified along paths")
                    others = sorted({*others, *extra})
                elif g.spouses([b]):
                    raise ValueError("with bidirected links the coefficients are not those of a regression on parents")
                m = data.moments([Question((b,), (), (a, *others))])[0]
                coef[a, b] = float(regression(m, b, [a, *others])[0][0])
        elif links:
            raise ValueError("method is parents, optimal or links")
        return {k: float(sum(np.prod([coef[a, b] for a, b in zip(p, p[1:])]) for p in ps)) for k, ps in paths.items()}
