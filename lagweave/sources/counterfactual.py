"""Structural models whose worlds share their noise: interventions and counterfactuals, a row for each realisation.

A model is a list of equations in causal order, each a function from a view of earlier variables to a Column; so a world is a
projection, and realisations are as parallel as rows. Time series are unrolled: variable x at step t is the column x__t, and a view's lagged
values are earlier columns; beyond the first step they are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Equation = Callable[["View"], Column]


class View:
    """What an equation sees: view[name] and view[name, -lag], and its own noise."""

    def __init__(self, values: dict[str, Column], step: int | None, own: str, log: list[tuple[str, int]] | None = None):
        self.values, self.step, self.own, self.log = values, step, own, log

    def __getitem__(self, key) -> Column:
        name, lag = key if isinstance(key, tuple) else (key, 0)
        if lag > 0 or (self.step is None and lag):
            raise ValueError("equations see earlier values only")
        if self.log is not None:
            self.log.append((name, lag))
        if self.step is None:
            return self.values[name]
        return self.values.get(f"{name}__{self.step + lag}", F.lit(0.0))

    @property
    def noise(self) -> Column:
        return F.col(f"noise_{self.own}" + ("" if self.step is None else f"__{self.step}"))


class Model:
    """equations: {name: equation}, in causal order; steps: length of the unrolled series, None for plain rows."""

    def __init__(self, equations: dict[str, Equation], steps: int | None = None):
        self.equations, self.steps = dict(equations), steps
        self.parents()

    def parents(self) -> dict[str, list[tuple[str, int]]]:
        """(name, lag) that each equation reads; raises if one reads what comes later."""
        known, out = set(), {}
        for name, equation in self.equations.items():
            log: list[tuple[str, int]] = []
            ends = {k: F.lit(0.0) for k in self.equations}
            step = None if self.steps is None else max(0, self.steps - 1)
            equation(View(ends if step is None else {f"{k}__{step}": v for k, v in ends.items()}, step, name, log))
            if any(lag == 0 and n not in known for n, lag in log):
                raise ValueError(f"{name} reads what is not yet there")
            known.add(name)
            out[name] = list(dict.fromkeys(log))
        return out

    def links(self) -> dict[int, list[tuple[int, int]]]:
        place = {n: k for k, n in enumerate(self.equations)}
        return {place[n]: [(place[p], lag) for p, lag in ps] for n, ps in self.parents().items()}

    def intervened(self, changes: dict[str, float | Equation]) -> Model:
        """Equations replaced by others, or by values."""
        fixed = {k: (v if callable(v) else (lambda view, v=v: F.lit(float(v)))) for k, v in changes.items()}
        return Model({n: fixed.get(n, e) for n, e in self.equations.items()}, self.steps)

    def names(self) -> list[str]:
        return list(self.equations) if self.steps is None else [f"{n}__{t}" for t in range(self.steps) for n in self.equations]

    def noise(self, spark: SparkSession, rows: int, seed: int = 0, kinds: dict[str, Callable[[int], Column]] | None = None) -> DataFrame:
        """(id, noise_...): standard normal noise, or kinds[name](seed), for each variable (and step), shared by all worlds."""
        kinds = kinds or {}
        df = spark.range(rows)
        columns = []
        for k, name in enumerate(self.names()):
            own = name.split("__")[0]
            draw = kinds.get(own, F.randn)
            columns.append(draw(seed * 100_003 + k).alias(f"noise_{name}"))
        return df.select("id", *columns)

    def world(self, given: DataFrame, prefix: str = "", fixed: dict[str, Column] | None = None) -> DataFrame:
        """given (with noise) and the world's variables, named prefix + name; fixed: variables (x, or x__t) taken from elsewhere."""
        values, fixed = {}, fixed or {}
        df = given
        for name in self.names():
            own, _, step = name.partition("__")
            view = View({n: F.col(prefix + n) for n in values}, int(step) if step else None, own)
            value = fixed[name] if name in fixed else self.equations[own](view)
            df = df.withColumn(prefix + name, value)
            values[name] = True
        return df


def counterfactual(model: Model, given: DataFrame, source: str, x_from: float, x_to: float, mediators: Sequence[str], prefix: str = "c_") -> DataFrame:
    """Worlds a_ (source set to x_from), b_ (to x_to) and the counterfactual one: source from b_, mediators from a_, noise the same in all."""
    every = lambda n: [n] if model.steps is None else [f"{n}__{t}" for t in range(model.steps)]
    df = model.intervened({source: x_from}).world(given, "a_")
    df = model.intervened({source: x_to}).world(df, "b_")
    fixed = {k: F.col("b_" + k) for k in every(source)} | {k: F.col("a_" + k) for n in mediators for k in every(n)}
    return model.world(df, prefix, fixed)


def natural_direct_effect(model: Model, spark: SparkSession, source: str, target: str, mediators: Sequence[str], x_from: float, x_to: float, rows: int = 100_000, seed: int = 0) -> float:
    """Ground truth E[Y(x_to, M(x_from)) - Y(x_from)], at the last step of a series."""
    end = target if model.steps is None else f"{target}__{model.steps - 1}"
    df = counterfactual(model, model.noise(spark, rows, seed), source, x_from, x_to, mediators)
    return float(df.agg(F.avg(F.col("c_" + end) - F.col("a_" + end))).first()[0])


def natural_indirect_effect(model: Model, spark: SparkSession, source: str, target: str, mediators: Sequence[str], x_from: float, x_to: float, rows: int = 100_000, seed: int = 0) -> float:
    """Ground truth E[Y(x_from, M(x_to)) - Y(x_from)]."""
    end = target if model.steps is None else f"{target}__{model.steps - 1}"
    df = counterfactual(model, model.noise(spark, rows, seed), source, x_to, x_from, mediators)
    return float(df.agg(F.avg(F.col("c_" + end) - F.col("b_" + end))).first()[0])


def category_shares(df: DataFrame, name: str, categories: Sequence[float]) -> np.ndarray:
    """Shares of a discrete variable's categories in a world."""
    return np.array(df.agg(*[F.avg((F.col(name) == float(c)).cast("double")) for c in categories]).first(), float)


def direct_effect_curve(model: Model, spark: SparkSession, source: str, target: str, mediators: Sequence[str], points: Sequence[float], delta: float = 0.5, rows: int = 20_000, seed: int = 0) -> np.ndarray:
    """Ground-truth direct effects of changes by delta from each point."""
    return np.array([natural_direct_effect(model, spark, source, target, mediators, p, p + delta, rows, seed) for p in points])
