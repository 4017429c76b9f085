"""Linear models of a time-series graph: coefficients, mediated and total effects, prediction, simulation.

Everything is a function of one moment matrix; the tables that grow with the data are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators.ci import Data, ParCorr, Question
from lagweave.operators.embedding import Node, column, lagged
from lagweave.operators.moments import Moments, moments, resampled_moments
from lagweave.sources.panel import Panel

from .pcmci import Discovery


def regression(m: Moments, target: Node, on: Sequence[Node], standard: bool = False) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ordinary least squares."""
    if not on:
        return np.empty(0), float(m.mean[m.at([target])[0]])
    i, j = m.at(list(on)), m.at([target])[0]
    coef = np.linalg.lstsq(m.cov[np.ix_(i, i)], m.cov[i, j], rcond=None)[0]
    base = float(m.mean[j] - coef @ m.mean[i])
    if standard:
        return coef * np.sqrt(np.diag(m.cov)[i] / m.cov[j, j]), 0.0
    return coef, base


@dataclass
class LinearModel:
    """One linear model for each variable on its parents."""

    parents: dict[int, list[Node]]
    coef: dict[int, np.ndarray]
    base: dict[int, float]
    n: int
    tau_max: int

    @classmethod
    def fit(cls, panel: Panel, parents: dict[int, list[Node]], tau_max: int | None = None, standard: bool = False) -> LinearModel:
        tau_max = max([0, *(-lag for ps in parents.values() for _, lag in ps)]) if tau_max is None else tau_max
        nodes = sorted({(j, 0) for j in range(panel.n)} | {n for ps in parents.values() for n in ps})
        m = moments(lagged(panel, nodes, tau_max), nodes)[()]
        return cls.of(m, parents, panel.n, tau_max, standard)

    @classmethod
    def of(cls, m: Moments, parents: dict[int, list[Node]], n: int, tau_max: int, standard: bool = False) -> LinearModel:
        fits = {j: regression(m, (j, 0), parents.get(j, []), standard) for j in range(n)}
        return cls({j: list(parents.get(j, [])) for j in range(n)}, {j: c for j, (c, _) in fits.items()}, {j: b for j, (_, b) in fits.items()}, n, tau_max)

    def tensor(self) -> np.ndarray:
        """Phi[tau, j, i]: coefficient of i at lag tau in the model of j."""
        phi = np.zeros((self.tau_max + 1, self.n, self.n))
        for j, ps in self.parents.items():
            for (i, lag), c in zip(ps, self.coef[j]):
                phi[-lag, j, i] = c
        return phi

    def prediction(self, panel: Panel) -> DataFrame:
        """(dataset, t, p0..): each variable from its parents, a column expression."""
        nodes = [n for ps in self.parents.values() for n in ps] or [(0, 0)]
        df = lagged(panel, nodes, self.tau_max)
        out = []
        for j in range(self.n):
            e = F.lit(self.base[j])
            for node, c in zip(self.parents[j], self.coef[j]):
                e = e + F.col(column(node)) * F.lit(float(c))
            out.append(e.alias(f"p{j}"))
        return df.select("dataset", "t", *out)

    def residuals(self, panel: Panel) -> DataFrame:
        """(dataset, t, r0..)."""
        own = self.prediction(panel).join(panel.df, ["dataset", "t"])
        return own.select("dataset", "t", *[(F.col(f"v{j}") - F.col(f"p{j}")).alias(f"r{j}") for j in range(self.n)])

    def residual_covariance(self, panel: Panel) -> np.ndarray:
        r = self.residuals(panel)
        row = r.agg(F.count(F.lit(1)), *[F.covar_samp(f"r{i}", f"r{j}") for i in range(self.n) for j in range(self.n)]).first()
        if row[0] <= 10:
            raise ValueError("too few rows that all models share")
        return np.array(row[1:], float).reshape(self.n, self.n)


class Mediation:
    """Effects along the paths of a linear model: with Psi[tau, j, i], the total effect of i on j after tau steps."""

    def __init__(self, phi: np.ndarray):
        self.phi, self.n, self.tau_max = phi, phi.shape[1], phi.shape[0] - 1
        self.psi = self.total(phi)

    @classmethod
    def fit(cls, panel: Panel, parents: dict[int, list[Node]], tau_max: int | None = None, standard: bool = True) -> Mediation:
        return cls(LinearModel.fit(panel, parents, tau_max, standard).tensor())

    @staticmethod
    def total(phi: np.ndarray) -> np.ndarray:
        start = np.linalg.pinv(np.eye(phi.shape[1]) - phi[0])
        psi = np.zeros_like(phi)
        psi[0] = start
        for tau in range(1, len(phi)):
            psi[tau] = sum(start @ phi[s] @ psi[tau - s] for s in range(1, tau + 1))
        return psi

    def without(self, k: int) -> np.ndarray:
        """Psi of the paths that do not lead through k."""
        phi = self.phi.copy()
        phi[:, k, :] = 0
        return self.total(phi)

    def coefficient(self, i: int, tau: int, j: int) -> float:
        return float(self.phi[abs(tau), j, i])

    def effect(self, i: int, tau: int, j: int) -> float:
        return float(self.psi[abs(tau), j, i])

    def strongest(self, i: int, j: int) -> float:
        path = self.psi[1 if i == j else 0 :, j, i]
        return float(path[np.abs(path).argmax()])

    def mediated(self, i: int, tau: int, j: int, k: int) -> float:
        """The part of an effect that leads through k."""
        return self.effect(i, tau, j) - float(self.without(k)[abs(tau), j, i])

    def conditional_mediated(self, i: int, tau: int, j: int, k: int, notk: Sequence[int]) -> float:
        """The part that leads through k and through none of notk."""
        phi = self.phi.copy()
        phi[:, list(notk), :] = 0
        own = self.total(phi)[abs(tau), j, i]
        phi[:, k, :] = 0
        return float(own - self.total(phi)[abs(tau), j, i])

    def joint(self, sources: Sequence[Node], j: int) -> float:
        """Effect of a joint unit change of several (variable, lag), each along paths that avoid the others."""
        out = 0.0
        for i, lag in sources:
            phi = self.phi.copy()
            others = [k for k, _ in sources if k != i]
            phi[:, others, :] = 0
            out += float(self.total(phi)[-lag, j, i])
        return out

    def joint_effect(self, i: int, j: int) -> np.ndarray:
        """Effect of every lag of i, at index lag, on j, along paths that don't come back to i."""
        return self.without(i)[:, j, i]

    def joint_matrix(self, i: int, j: int) -> np.ndarray:
        """(lag of i, lag of j): the effect of i at one time on j at another, along paths that don't come back to i."""
        own, n = self.joint_effect(i, j), self.tau_max + 1
        out = np.zeros((n, n))
        for later in range(n):
            out[later:, later] = own[: n - later]
        return out

    def joint_mediated(self, i: int, j: int, k: int | Sequence[int]) -> np.ndarray:
        """The part of joint_effect that leads through k."""
        phi = self.phi.copy()
        phi[:, [i, *([k] if np.isscalar(k) else k)], :] = 0
        return self.joint_effect(i, j) - self.total(phi)[:, j, i]

    def paths(self, i: int, tau: int, j: int) -> list[tuple[list[Node], float]]:
        """Every path of links from i at -tau to j at 0, with the product of its coefficients: their sum is the effect."""
        out, todo = [], [([(i, -abs(tau))], 1.0)]
        while todo:
            path, product = todo.pop()
            v, t = path[-1]
            if (v, t) == (j, 0) and len(path) > 1:
                out.append((path, product))
                continue
            for lag, child in zip(*np.nonzero(self.phi[:, :, v])):
                node = (int(child), t + int(lag))
                if node[1] <= 0 and node not in path:
                    todo.append(([*path, node], product * float(self.phi[lag, child, v])))
        return sorted(out)

    def _reach(self, i: int, j: int, lags: str) -> float:
        part = np.abs(self.psi[:, j, i])
        return float(part.max() if lags == "absmax" else part.sum())

    def average_effect(self, i: int, lags: str = "absmax") -> float:
        """Mean effect of i on the others."""
        return float(np.mean([self._reach(i, j, lags) for j in range(self.n) if j != i]))

    def average_susceptibility(self, j: int, lags: str = "absmax") -> float:
        """Mean effect of the others on j."""
        return float(np.mean([self._reach(i, j, lags) for i in range(self.n) if i != j]))

    def average_mediated(self, k: int, lags: str = "absmax") -> float:
        """Mean effect between other variables that k mediates."""
        less = np.abs(self.psi - self.without(k))
        pairs = [(i, j) for i in range(self.n) for j in range(self.n) if len({i, j, k}) == 3]
        return float(np.mean([less[:, j, i].max() if lags == "absmax" else less[:, j, i].sum() for i, j in pairs]))

    def val_matrix(self) -> np.ndarray:
        return np.transpose(self.phi, (2, 1, 0))


def bootstrap_effects(panel: Panel, parents: dict[int, list[Node]], tau_max: int, of, samples: int = 100, block: int = 1, seed: int = 0, level: float = 0.9, standard: bool = True) -> tuple[float, float]:
    """Interval of a number of(Mediation) over block-bootstrap samples, all from one grouped pass."""
    nodes = sorted({(j, 0) for j in range(panel.n)} | {n for ps in parents.values() for n in ps})
    got = resampled_moments(lagged(panel, nodes, tau_max), nodes, samples, block, seed)
    values = [of(Mediation(LinearModel.of(m, parents, panel.n, tau_max, standard).tensor())) for _, m in sorted(got.items())]
    low, high = np.quantile(values, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


class Prediction:
    """Forecasts of a target from features selected on training times: train and test are conditions on t."""

    def __init__(self, panel: Panel, train, test):
        keep = lambda c: Panel(panel.df.select("dataset", "t", *[F.when(c, F.col(f"v{i}")).alias(f"v{i}") for i in range(panel.n)]), panel.names)
        self.panel, self.train, self.test = panel, keep(train), test

    def predictors(self, target: int, steps: int, tau_max: int, alpha: float = 0.2) -> list[Node]:
        """Lagged parents of the target, at least `steps` back."""
        found, _, _ = Discovery(self.train, ParCorr()).parents(tau_max, steps, alpha)
        return found[target]

    def fit(self, target: int, predictors: list[Node], tau_max: int) -> LinearModel:
        nodes = sorted({(target, 0), *predictors})
        m = moments(lagged(self.train, nodes, tau_max), nodes)[()]
        self.target = target
        coef, base = regression(m, (target, 0), predictors)
        self.model = LinearModel({target: predictors}, {target: coef}, {target: base}, self.panel.n, tau_max)
        return self.model

    def predict(self) -> DataFrame:
        """(dataset, t, actual, predicted) at the test times."""
        j = self.target
        e = F.lit(self.model.base[j])
        for node, c in zip(self.model.parents[j], self.model.coef[j]):
            e = e + F.col(column(node)) * F.lit(float(c))
        df = lagged(self.panel, [(j, 0), *self.model.parents[j]], self.model.tau_max)
        return df.where(self.test).select("dataset", "t", F.col(column((j, 0))).alias("actual"), e.alias("predicted"))


def total_effect(panel: Panel, x: Sequence[Node], y: Node, adjust: Sequence[Node], tau_max: int) -> np.ndarray:
    """Linear total effects of the x on y, given a valid adjustment set."""
    data = Data(panel, tau_max, "tau_max")
    m = data.moments([data.expanded(Question(tuple(x), (y,), tuple(adjust)))])[0]
    return regression(m, y, [*x, *adjust])[0][: len(x)]
