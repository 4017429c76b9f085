"""Synthetic series from structural models. A realisation is sequential in time, so each is one task; ensembles fan out."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Links = dict[int, list[tuple[tuple[int, int], float, Callable | None]]]


def contemporaneous_order(links: Links) -> list[int]:
    left = {j: {p[0][0] for p in ps if p[0][1] == 0} for j, ps in links.items()}
    order: list[int] = []
    while left:
        free = sorted(j for j, p in left.items() if not p & set(left))
        if not free:
            raise ValueError("links at lag 0 form a cycle")
        order += free
        for j in free:
            del left[j]
    return order


def structural_process(links: Links, length: int, seed: int = 0, noise: Callable | dict[int, Callable] | None = None, do: dict[int, np.ndarray] | None = None, soft: bool = False, transient: float = 0.2) -> tuple[np.ndarray, bool]:
    """(length, variables) and whether it diverged. noise(rng, n): for all variables, or by variable. do: by variable an array of values, NaN where there is no intervention; soft interventions add."""
    n, deep = len(links), max([0, *(-p[0][1] for ps in links.values() for p in ps)])
    run_in = int(transient * length)
    rng = np.random.default_rng(seed)
    total = length + run_in
    draw = lambda j: noise.get(j) if isinstance(noise, dict) else noise
    x = np.stack([draw(j)(rng, total) if draw(j) else rng.standard_normal(total) for j in range(n)], axis=1)
    order = contemporaneous_order(links)
    for t in range(deep, total):
        for j in order:
            for (i, lag), c, *f in links[j]:
                v = x[t + lag, i]
                x[t, j] += c * (f[0](v) if f and f[0] is not None else v)
            if do and j in do and t >= run_in and not np.isnan(do[j][t - run_in]):
                x[t, j] = do[j][t - run_in] + (x[t, j] if soft else 0)
        if not np.isfinite(x[t]).all() or np.abs(x[t]).max() > 1e100:
            return x[run_in:], True
    return x[run_in:], False


def lag_tensor(links: Links) -> np.ndarray:
    deep = max([0, *(-p[0][1] for ps in links.values() for p in ps)])
    phi = np.zeros((deep + 1, len(links), len(links)))
    for j, ps in links.items():
        for (i, lag), c, *_ in ps:
            phi[-lag, j, i] += c
    return phi


def stationary(links: Links) -> bool:
    """Whether the linear model's companion matrix has all eigenvalues inside the unit circle."""
    phi = lag_tensor(links)
    n, deep = phi.shape[1], phi.shape[0] - 1
    if not deep:
        return True
    start = np.linalg.inv(np.eye(n) - phi[0])
    top = np.concatenate([start @ phi[k] for k in range(1, deep + 1)], axis=1)
    companion = np.concatenate([top, np.eye(n * (deep - 1), n * deep)], axis=0)
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 1)


#: Functions for random models beside the identity.
NONLINEAR = (lambda x: x + 5.0 * x**2 * np.exp(-(x**2) / 20.0), np.tanh)
#: Noise by name: centred, of scale 1.
NOISES: dict[str, Callable] = {
    "gaussian": lambda rng, n: rng.standard_normal(n),
    "uniform": lambda rng, n: rng.uniform(-0.5, 0.5, n),
    "weibull": lambda rng, n: rng.weibull(2, n) - math.gamma(1.5),
}


def random_links(n: int, n_links: int, tau_max: int, coefficients=(-0.5, 0.5), auto=(0.3, 0.5), contemporaneous: float = 0.3, seed: int = 0, tries: int = 1000, functions: Sequence[Callable | None] = (None,)) -> Links:
    """A random stationary model with distinct cross links, a share of them at lag 0 in a random causal order, of randomly chosen functions (None: linear).
    Models that are not linear are tried by a short realisation."""
    rng = np.random.default_rng(seed)
    for attempt in range(tries):
        links: Links = {j: [((j, -1), float(rng.choice(auto)), None)] if any(auto) else [] for j in range(n)}
        rank = rng.permutation(n)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        for k in rng.permutation(len(pairs))[:n_links]:
            i, j = pairs[k]
            at_once = rng.random() < contemporaneous
            if at_once and rank[i] > rank[j]:
                i, j = j, i
            if any(p[0][0] == i for p in links[j] if p[0][0] != j):
                continue
            f = functions[int(rng.integers(len(functions)))] if len(functions) > 1 else functions[0]
            links[j].append(((i, 0 if at_once else -int(rng.integers(1, tau_max + 1))), float(rng.choice(coefficients)), f))
        if stationary(links) and (all(f is None for f in functions) or not structural_process(links, 500, attempt)[1]):
            return links
    raise ValueError("no stationary model found")


def random_noises(n: int, kinds: Sequence[str] = ("gaussian",), scales=(0.5, 2.0), seed: int = 0) -> dict[int, Callable]:
    """For each variable noise of a randomly chosen kind and scale."""
    rng = np.random.default_rng(seed)
    out = {}
    for j in range(n):
        kind, scale = NOISES[kinds[int(rng.integers(len(kinds)))]], float(rng.uniform(*scales))
        out[j] = lambda g, m, kind=kind, scale=scale: scale * kind(g, m)
    return out


def var_process(links: Links, length: int, covariance: np.ndarray | None = None, inverse: bool = False, seed: int = 0, initial: np.ndarray | None = None) -> np.ndarray:
    """A linear process of lagged links with correlated normal innovations; inverse: covariance is the sign-flipped partial one, to be inverted. The first rows are pure noise, or given."""
    phi = lag_tensor(links)
    if np.abs(phi[0]).max(initial=0) > 0:
        raise ValueError("links of this process are lagged; what happens at once is in the innovations' covariance")
    if not stationary(links):
        raise ValueError("the process is not stationary")
    n, deep = phi.shape[1], len(phi) - 1
    c = np.eye(n) if covariance is None else np.asarray(covariance, float)
    if inverse:
        flipped = -c
        np.fill_diagonal(flipped, np.diag(c))
        c = np.linalg.inv(flipped)
    x = np.random.default_rng(seed).multivariate_normal(np.zeros(n), c, length)
    if initial is not None:
        x[:deep] = np.asarray(initial, float)[:deep]
    for t in range(deep, length):
        for k in range(1, deep + 1):
            x[t] += phi[k] @ x[t - k]
    return x


def parents_of_links(links: Links) -> dict[int, list[tuple[int, int]]]:
    return {j: [p[0] for p in ps] for j, ps in links.items()}


def ensemble(spark: SparkSession, links: Links, length: int, realisations: int, seed: int = 0, noise: Callable | None = None) -> DataFrame:
    """(dataset, t, v0..): realisations in parallel, one task's work each."""
    n = len(links)
    schema = "dataset string, t long, " + ", ".join(f"v{i} double" for i in range(n))

    def run(t: pa.Table) -> pa.Table:
        m = t.column("id")[0].as_py()
        x, bad = structural_process(links, length, seed * realisations + m, noise)
        if bad:
            raise ValueError(f"realisation {m} diverges")
        return pa.table({"dataset": pa.array([str(m)] * length), "t": np.arange(length)} | {f"v{i}": x[:, i] for i in range(n)})

    return spark.range(realisations).groupBy("id").applyInArrow(run, schema)


def surrogates(model, covariance: np.ndarray | None, length: int, seed: int = 0, residuals: np.ndarray | None = None, block: int = 1) -> np.ndarray:
    """A series of a fitted linear model (coefficients by variable): with normal noise of the residuals' covariance, or with its residuals (rows) drawn again in blocks."""
    rng = np.random.default_rng(seed)
    run_in = length // 5
    if residuals is not None:
        starts = rng.integers(0, max(1, len(residuals) - block + 1), -(-(length + run_in) // block))
        noise = residuals[(starts[:, None] + np.arange(block)).ravel()[: length + run_in] % len(residuals)]
    else:
        noise = rng.multivariate_normal(np.zeros(model.n), covariance, length + run_in)
    phi, base = model.tensor(), np.array([model.base[j] for j in range(model.n)])
    start = np.linalg.inv(np.eye(model.n) - phi[0])
    x = noise.copy()
    for t in range(model.tau_max, len(x)):
        x[t] = start @ (base + noise[t] + sum(phi[k] @ x[t - k] for k in range(1, model.tau_max + 1)))
    return x[run_in:]


def context_model(spark: SparkSession, links: Links, classes: dict[int, str], datasets: int, length: int, seed: int = 0, noise: Callable | dict[int, Callable] | None = None) -> DataFrame:
    """(dataset, t, v0..): datasets of one model that share their time context (the same in all) and have space context that is constant in time; one task's work each.
    classes: system, time_context or space_context by variable, system where none is given."""
    kind = {j: classes.get(j, "system") for j in links}
    part = lambda c: {j: links[j] for j in links if kind[j] == c}
    for j, ps in links.items():
        if kind[j] != "system" and any(kind[p[0][0]] != kind[j] for p in ps):
            raise ValueError("context depends on context of its own kind only")
    n = len(links)

    def own_process(group: Links, rows: int, seeds, transient: float) -> dict[int, np.ndarray]:
        place = {j: k for k, j in enumerate(group)}
        moved = {place[j]: [((place[p[0][0]], p[0][1]), *p[1:]) for p in ps] for j, ps in group.items()}
        draws = {place[j]: noise[j] for j in group if isinstance(noise, dict) and j in noise} if isinstance(noise, dict) else noise
        x, bad = structural_process(moved, rows, seeds, draws, transient=transient)
        if bad:
            raise ValueError("the context diverges")
        return {j: x[:, k] for j, k in place.items()}

    in_time = own_process(part("time_context"), length, [1, seed], 0.2) if part("time_context") else {}
    in_space = own_process(part("space_context"), datasets, [2, seed], 0.0) if part("space_context") else {}
    schema = "dataset string, t long, " + ", ".join(f"v{j} double" for j in range(n))

    def run(t: pa.Table) -> pa.Table:
        m = t.column("id")[0].as_py()
        fixed = in_time | {j: np.full(length, v[m]) for j, v in in_space.items()}
        x, bad = structural_process(links, length, [3, seed, m], noise, do=fixed)
        if bad:
            raise ValueError(f"dataset {m} diverges")
        return pa.table({"dataset": pa.array([str(m)] * length), "t": np.arange(length)} | {f"v{j}": x[:, j] for j in range(n)})

    return spark.range(datasets).groupBy("id").applyInArrow(run, schema)


def with_shared_drivers(df: DataFrame, n_datasets: int) -> DataFrame:
    """One-hot columns of the dataset, for models that pool datasets."""
    return df.withColumns({f"space_{k}": F.when(F.col("dataset") == str(k), 1.0).otherwise(0.0) for k in range(n_datasets)})
