"""Conditional-independence tests, evaluated in batches.

A test asks whether X and Y (sets of nodes) are independent given Z. All linear tests of a batch are
closed forms of one moment matrix; contingency tests are one grouped count; tests on samples
(nearest neighbours, Gaussian processes, ranks) run in one grouped Arrow function, a task for each test.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.special import chi2_sf, digamma, norm_ppf, t_ppf, t_sf
from lagweave.sources.panel import Panel

from .embedding import Node, column, first_time, lagged, mask_column, roles
from .moments import Moments, moments


@dataclass(frozen=True)
class Question:
    """X independent of Y given Z?"""

    x: tuple[Node, ...]
    y: tuple[Node, ...]
    z: tuple[Node, ...] = ()


@dataclass
class Answer:
    val: float
    p: float
    n: int = 0
    dim: int = 0
    conf: tuple[float, float] | None = None


@dataclass
class Data:
    """A panel prepared for questions up to tau_max: one embedding for all of them."""

    panel: Panel
    tau_max: int
    cut_off: str = "2xtau_max"
    mask_type: str | None = None
    keys: list[str] = field(default_factory=list)
    frame: DataFrame | None = None
    _nodes: set[Node] = field(default_factory=set)
    _whole: dict[tuple, Moments] | None = None
    _gaps: bool | None = None

    def embedding(self) -> DataFrame:
        """All nodes up to twice tau_max (the furthest that a conditioning set reaches), or tau_max for shorter cut-offs."""
        if self.frame is None:
            deep = self.tau_max if self.cut_off in ("tau_max", "max_lag_or_tau_max") else 2 * self.tau_max
            nodes = [(v, -k) for v in range(self.panel.n) for k in range(deep + 1)]
            self._nodes = set(nodes)
            self.frame = lagged(self.panel, nodes, first_time(self.cut_off, 0, self.tau_max), masks=self.mask_type is not None).persist()
        return self.frame

    def release(self) -> None:
        """Gives the kept embedding back."""
        if self.frame is not None and self._nodes:
            self.frame.unpersist()
            self.frame = None

    def nodes(self) -> list[Node]:
        self.embedding()
        return sorted(self._nodes) if self._nodes else sorted({(int(c[1:].split("_")[0]), -int(c.split("_")[1])) for c in self.frame.columns if c[0] == "x" and "_" in c})

    def gaps(self) -> bool:
        """Whether tests may use different rows: masks, missing values or cut-offs that depend on the test."""
        if self._gaps is None:
            missing = self.panel.df.agg(F.max(F.greatest(*[F.col(f"v{i}").isNull().cast("int") for i in range(self.panel.n)], F.lit(0)))).first()[0]
            self._gaps = bool(missing) or (self.panel.masked and bool(self.mask_type)) or self.cut_off not in ("2xtau_max", "tau_max")
        return self._gaps

    def expanded(self, q: Question) -> Question:
        x, y, z, _ = roles(self.panel, q.x, q.y, q.z)
        return Question(tuple(x), tuple(y), tuple(z))

    def whole(self) -> Moments:
        if self._whole is None:
            self._whole = moments(self.embedding(), self.nodes())
        return self._whole[()]

    def moments(self, questions: Sequence[Question]) -> list[Moments]:
        """Moments of each question's nodes over its own rows."""
        if not self.gaps():
            return [self.whole()] * len(questions)
        return question_moments(self, questions)

    def valid(self, q: Question):
        """Column: whether a row belongs to the question's sample."""
        ok = F.lit(True)
        for node in (*q.x, *q.y, *q.z):
            ok = ok & F.col(column(node)).isNotNull()
        if self.cut_off not in ("2xtau_max", "tau_max"):
            ok = ok & (F.col("t") >= max(-lag for _, lag in (*q.x, *q.y, *q.z)))
        if self.panel.masked and self.mask_type:
            for role in self.mask_type:
                for node in getattr(q, role):
                    ok = ok & ~F.col(mask_column(node))
        return ok

    def samples(self, questions: Sequence[Question], fn, schema: str) -> DataFrame:
        """fn(question number, sample (rows, nodes), question) -> rows; one group for each question."""
        parts = []
        for k, q in enumerate(questions):
            nodes = [*q.x, *q.y, *q.z]
            parts.append(F.when(self.valid(q), F.struct(F.lit(k).alias("k"), F.array(*[F.col(column(n)) for n in nodes]).alias("v"))))
        rows = self.embedding().select("dataset", "t", F.explode(F.array_compact(F.array(*parts))).alias("r")).select("dataset", "t", "r.k", "r.v")
        asked = list(questions)
        kinds = pa.schema([(name, {"long": pa.int64(), "double": pa.float64()}[kind]) for name, kind in (c.split() for c in schema.split(", "))])

        def run(t: pa.Table) -> pa.Table:
            k = t.column("k")[0].as_py()
            t = t.sort_by([("dataset", "ascending"), ("t", "ascending")])
            q, v = asked[k], t.column("v").combine_chunks()
            v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, len(q.x) + len(q.y) + len(q.z))
            return pa.Table.from_pylist(fn(k, x, q), schema=kinds)

        return rows.groupBy("k").applyInArrow(run, schema)


def question_moments(data: Data, questions: Sequence[Question]) -> list[Moments]:
    """One pass over the embedding; each task adds up every question's own rows."""
    nodes = [[*q.x, *q.y, *q.z] for q in questions]
    df = data.embedding().select(*data.embedding().columns, *[data.valid(q).alias(f"ok{k}") for k, q in enumerate(questions)])

    def add(batches):
        total = {}
        for batch in batches:
            held = {}
            for k, part in enumerate(nodes):
                ok = batch.column(f"ok{k}").to_numpy(zero_copy_only=False).astype(bool)
                for n in part:
                    if n not in held:
                        held[n] = batch.column(column(n)).to_numpy(zero_copy_only=False).astype(float)
                x = np.stack([np.ones(len(batch)), *(held[n] for n in part)], axis=1)[ok]
                total[k] = total.get(k, 0) + x.T @ x
        for k, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_pydict({"k": np.full(len(i), k, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "s": m[i, j]})

    rows = df.mapInArrow(add, "k int, i int, j int, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = [np.zeros((len(p) + 1, len(p) + 1)) for p in nodes]
    for r in rows:
        out[r["k"]][r["i"], r["j"]] = out[r["k"]][r["j"], r["i"]] = r["s"]
    done = []
    for part, m in zip(nodes, out):
        n = max(m[0, 0], 1e-300)
        mean = m[0, 1:] / n
        done.append(Moments(round(m[0, 0]), part, mean, m[1:, 1:] / n - np.outer(mean, mean)))
    return done


def conditional(m: Moments, left: Sequence[Node], z: Sequence[Node]) -> np.ndarray:
    """Covariance of the residuals of left on z."""
    a, b = m.at(list(left)), m.at([n for n in z if m.cov[m.nodes.index(n), m.nodes.index(n)] > 0])
    s = m.cov[np.ix_(a, a)]
    if not len(b):
        return s
    scale = np.sqrt(np.diag(m.cov)[b])
    inner = m.cov[np.ix_(b, b)] / scale[:, None] / scale
    cross = m.cov[np.ix_(b, a)] / scale[:, None]
    return s - cross.T @ np.linalg.lstsq(inner, cross, rcond=1e-12)[0]


class ParCorr:
    """Partial correlation: correlation of the residuals of X and Y on Z; Student's test."""

    name, two_sided = "par_corr", True

    def run(self, data: Data, questions: Sequence[Question]) -> list[Answer]:
        asked = [data.expanded(q) for q in questions]
        return [self.answer(m, q) for m, q in zip(data.moments(asked), asked)]

    def answer(self, m: Moments, q: Question) -> Answer:
        if len(q.x) != 1 or len(q.y) != 1:
            raise ValueError("partial correlation takes one variable on either side")
        dim = 2 + len(q.z)
        s = conditional(m, [q.x[0], q.y[0]], q.z)
        i = m.at([q.x[0], q.y[0]])
        if (np.diag(m.cov)[i] <= 0).any():
            return Answer(0.0, 1.0, m.n, dim)
        d = np.sqrt(np.maximum(np.diag(s), 0))
        val = float(np.clip(s[0, 1] / (d[0] * d[1]), -1, 1)) if d.min() > 0 else 0.0
        return Answer(val, self.p_value(val, m.n, dim), m.n, dim)

    @staticmethod
    def p_value(val: float, n: int, dim: int) -> float:
        df = n - dim
        if df < 1:
            return math.nan
        if abs(abs(val) - 1) < 1e-12:
            return 0.0
        return 2 * t_sf(abs(val) * math.sqrt(df / (1 - val * val)), df)

    @staticmethod
    def confidence(val: float, n: int, dim: int, level: float) -> tuple[float, float]:
        """Interval of the correlation at a level, from Student quantiles around its own statistic."""
        df = n - dim
        at = val * math.sqrt(df) / math.sqrt(1 - val * val)
        low, high = (at + t_ppf(q, df) for q in ((1 - level) / 2, (1 + level) / 2))
        return low / math.sqrt(df + low * low), high / math.sqrt(df + high * high)

    @staticmethod
    def reduced(x, y, z, rng) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of the one X and the one Y on Z and a constant."""
        z = np.concatenate([np.ones((len(x), 1)), z], axis=1)
        return residuals(x[:, 0], z), residuals(y[:, 0], z)

    @staticmethod
    def between(a: np.ndarray, b: np.ndarray) -> float:
        scale = a.std() * b.std()
        return float(np.mean((a - a.mean()) * (b - b.mean())) / scale) if scale > 0 else 0.0

    def score(self, data: Data, target: Node, parents: Sequence[Node], kind: str = "aic") -> float:
        """Information criterion of the linear model of target on parents; smaller is better."""
        q = data.expanded(Question((target,), (target,), tuple(parents)))
        m = data.moments([Question(q.x, (), q.z)])[0]
        rss = m.n * conditional(m, q.x, q.z)[0, 0] / max(m.part(list(q.x))[0, 0], 1e-300)
        k = len(q.z)
        fit = m.n * math.log(max(rss, 1e-300))
        return fit + {"aic": 2 * k, "bic": k * math.log(m.n), "aicc": 2 * k + 2 * k * (k + 1) / max(m.n - k - 1, 1)}[kind]


class ParCorrMult:
    """Several variables on either side: the largest residual correlation (Bonferroni), or Wilks' lambda of the canonical correlations (Bartlett)."""

    name, two_sided = "par_corr_mult", True

    def __init__(self, measure: str = "max_corr"):
        if measure not in ("max_corr", "wilks"):
            raise ValueError("measure is max_corr or wilks")
        self.measure = measure

    def run(self, data: Data, questions: Sequence[Question]) -> list[Answer]:
        asked = [data.expanded(q) for q in questions]
        return [self.answer(m, q) for m, q in zip(data.moments(asked), asked)]

    def answer(self, m: Moments, q: Question) -> Answer:
        dx, dy, dz = len(q.x), len(q.y), len(q.z)
        s = conditional(m, [*q.x, *q.y], q.z)
        d = np.sqrt(np.maximum(np.diag(s), 1e-300))
        c = s / d[:, None] / d
        if self.measure == "max_corr":
            part = c[:dx, dx:]
            val = float(part.flat[np.abs(part).argmax()])
            return Answer(val, min(1.0, ParCorr.p_value(val, m.n, dx + dy + dz) * dx * dy), m.n, dx + dy + dz)
        root = np.linalg.lstsq(c[:dx, :dx], c[:dx, dx:], rcond=None)[0] @ np.linalg.lstsq(c[dx:, dx:], c[dx:, :dx], rcond=None)[0]
        rho2 = np.clip(np.linalg.eigvals(root).real, 0, 1 - 1e-15)
        val = float(np.prod(1 - rho2))
        return Answer(val, chi2_sf(-(m.n - dz - 0.5 * (dx + dy + 1)) * math.log(val), dx * dy), m.n, dx + dy + dz)


    @staticmethod
    def reduced(x, y, z, rng) -> tuple[np.ndarray, np.ndarray]:
        z = np.concatenate([np.ones((len(x), 1)), z], axis=1)
        return residuals(x, z), residuals(y, z)

    def between(self, a: np.ndarray, b: np.ndarray) -> float:
        dx = a.shape[1]
        c = np.corrcoef(np.concatenate([a, b], axis=1), rowvar=False)
        if self.measure == "max_corr":
            part = c[:dx, dx:]
            return float(part.flat[np.abs(part).argmax()])
        root = np.linalg.lstsq(c[:dx, :dx], c[:dx, dx:], rcond=None)[0] @ np.linalg.lstsq(c[dx:, dx:], c[dx:, :dx], rcond=None)[0]
        return float(np.prod(1 - np.clip(np.linalg.eigvals(root).real, 0, 1 - 1e-15)))


def normal_scores(x: np.ndarray, edge: float = 1e-5) -> np.ndarray:
    """Ranks of each column (ties: the largest) as quantiles of the normal distribution."""
    out = np.empty_like(x)
    for k in range(x.shape[1]):
        u = np.searchsorted(np.sort(x[:, k]), x[:, k], "right") / len(x)
        u = np.where(u >= 1, 1 - edge, u)
        table = {v: norm_ppf(v) for v in np.unique(u)}
        out[:, k] = [table[v] for v in u]
    return out


def residuals(target: np.ndarray, z: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    if not z.shape[1]:
        return target
    if weight is None:
        return target - z @ np.linalg.lstsq(z, target, rcond=None)[0]
    return target - z @ np.linalg.lstsq(z * weight[:, None], target * weight, rcond=None)[0]


def arrays(x, y, z=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-dimensional (rows, variables)."""
    x, y = (np.asarray(a, float).reshape(len(a), -1) for a in (x, y))
    return x, y, np.empty((len(x), 0)) if z is None else np.asarray(z, float).reshape(len(x), -1)


class SampleTest:
    """A test that needs the sample itself: measure(x, y, z, generator) -> value, p and, if it gives one, the bounds of an interval.

    A typed test gets kinds too: flags of the discrete columns of x, y and z."""

    name, two_sided, typed = "", True, False

    def run(self, data: Data, questions: Sequence[Question], seed: int = 42) -> list[Answer]:
        asked = [data.expanded(q) for q in questions]
        out = [Answer(0.0, 1.0) for _ in asked]
        discrete = frozenset(data.panel.discrete)

        def one(k: int, v: np.ndarray, q: Question):
            a, b = len(q.x), len(q.x) + len(q.y)
            keep = v.std(axis=0) > 0
            x, y, z = v[:, :a][:, keep[:a]], v[:, a:b][:, keep[a:b]], v[:, b:][:, keep[b:]]
            more = {}
            if self.typed:
                flag = np.array([n[0] in discrete for n in (*q.x, *q.y, *q.z)], bool)
                more["kinds"] = flag[:a][keep[:a]], flag[a:b][keep[a:b]], flag[b:][keep[b:]]
            got = self.measure(x, y, z, np.random.default_rng([seed, k]), **more) if x.shape[1] and y.shape[1] else (0.0, 1.0)
            val, p, low, high = (*got, None, None)[:4]
            return [{"k": k, "val": float(val), "p": float(p), "n": len(v), "low": low and float(low), "high": high and float(high)}]

        for r in data.samples(asked, one, "k long, val double, p double, n long, low double, high double").collect():
            q = asked[r["k"]]
            out[r["k"]] = Answer(r["val"], r["p"], r["n"], len(q.x) + len(q.y) + len(q.z), None if r["low"] is None else (r["low"], r["high"]))
        return out

    def raw(self, x, y, z=None, seed: int = 42, **more) -> Answer:
        """The test on arrays (rows, variables)."""
        x, y, z = arrays(x, y, z)
        got = self.measure(x, y, z, np.random.default_rng([seed, 0]), **more)
        return Answer(float(got[0]), float(got[1]), len(x), x.shape[1] + y.shape[1] + z.shape[1], tuple(map(float, got[2:])) or None)


class RobustParCorr(SampleTest):
    """Partial correlation of the normal scores, taken within each test's sample."""

    name = "robust_par_corr"

    def reduced(self, x, y, z, rng):
        v = normal_scores(np.concatenate([x, y, z], axis=1))
        v = (v - v.mean(0)) / v.std(0)
        return residuals(v[:, 0], v[:, 2:]), residuals(v[:, 1], v[:, 2:])

    between = staticmethod(ParCorr.between)

    def measure(self, x, y, z, rng):
        val = self.between(*self.reduced(x, y, z, rng))
        return val, ParCorr.p_value(val, len(x), 2 + z.shape[1])


class ParCorrWLS(SampleTest):
    """Partial correlation for noise whose spread changes: weighted least squares.

    The spread is estimated from the absolute residuals: by `window` rows along time (expert "time"), or by the `window` nearest
    values of one parent in Z (expert: that parent's place in Z); or it is known: spreads of X and Y, one value a row.
    """

    name = "par_corr_wls"

    def __init__(self, window: int = 10, robust: bool = False, expert: str | int | tuple = "time", known: tuple[np.ndarray, np.ndarray] | None = None):
        self.window, self.robust, self.known = window, robust, known
        self.expert = expert if isinstance(expert, tuple) else (expert, expert)

    def rolling(self, r: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.abs(r))])
        out = np.ones(len(r))
        out[self.window - 1 :] = (total[self.window :] - total[: -self.window]) / self.window
        return np.maximum(out, 1e-12)

    def spread(self, r: np.ndarray, z: np.ndarray, by) -> np.ndarray:
        if by is None:
            return np.ones(len(r))
        if by == "time":
            return self.rolling(r)
        order = np.argsort(z[:, by], kind="stable")
        out = np.empty(len(r))
        half = self.window // 2
        total = np.concatenate([[0], np.cumsum(np.abs(r[order]))])
        low, high = np.maximum(np.arange(len(r)) - half, 0), np.minimum(np.arange(len(r)) + half + 1, len(r))
        out[order] = (total[high] - total[low]) / (high - low)
        return np.maximum(out, 1e-12)

    def reduced(self, x, y, z, rng):
        v = np.concatenate([x, y, z], axis=1)
        if self.robust:
            v = normal_scores(v)
        v = (v - v.mean(0)) / v.std(0)
        parts = []
        for k in (0, 1):
            s = np.asarray(self.known[k], float) if self.known is not None else self.spread(residuals(v[:, k], v[:, 2:]), z, self.expert[k])
            parts.append(residuals(v[:, k], v[:, 2:], 1 / s) / s)
        return parts

    between = staticmethod(ParCorr.between)

    def measure(self, x, y, z, rng):
        val = self.between(*self.reduced(x, y, z, rng))
        return val, ParCorr.p_value(val, len(x), 2 + z.shape[1])


def neighbours(v: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest other row in the maximum norm, in blocks."""
    out = np.empty(len(v))
    for a in range(0, len(v), 256):
        d = np.abs(v[a : a + 256, None, :] - v[None]).max(2)
        out[a : a + 256] = np.partition(d, k, axis=1)[:, k]
    return out


def within(v: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Rows (itself included) no further than radius in the maximum norm."""
    if not v.shape[1]:
        return np.full(len(radius), len(radius))
    out = np.empty(len(v), np.int64)
    for a in range(0, len(v), 256):
        out[a : a + 256] = (np.abs(v[a : a + 256, None, :] - v[None]).max(2) <= radius[a : a + 256, None]).sum(1)
    return out


class CMIknn(SampleTest):
    """Conditional mutual information by nearest neighbours; p from permutations of X among neighbours in Z."""

    name, two_sided = "cmi_knn", False

    def __init__(self, knn: float = 0.2, shuffle_neighbors: int = 5, samples: int = 200, transform: str = "ranks"):
        self.knn, self.shuffle, self.samples, self.transform = knn, shuffle_neighbors, samples, transform

    def prepared(self, v: np.ndarray, rng) -> np.ndarray:
        v = v + 1e-6 * v.std(0) * rng.random(v.shape)
        if self.transform == "ranks":
            return v.argsort(0).argsort(0).astype(float)
        if self.transform == "standardize":
            return (v - v.mean(0)) / v.std(0)
        if self.transform == "uniform":
            return np.stack([np.searchsorted(np.sort(c), c, "right") / len(c) for c in v.T], axis=1)
        return v

    def estimate(self, v: np.ndarray, dx: int, dy: int) -> float:
        n = len(v)
        k = max(1, int(self.knn * n)) if self.knn < 1 else int(self.knn)
        radius = neighbours(v, k) * 0.999999999
        x, y, z = v[:, :dx], v[:, dx : dx + dy], v[:, dx + dy :]
        xz, yz, only = within(np.concatenate([x, z], 1), radius), within(np.concatenate([y, z], 1), radius), within(z, radius)
        return float(digamma(np.array([k]))[0] - (digamma(xz) + digamma(yz) - digamma(only)).mean())

    def conditional_entropy(self, x, z, seed: int = 42) -> float:
        """Of X given Z, in nats: neighbours of (X, Z) and of Z at the same distances."""
        x, z, _ = arrays(x, z)
        v = self.prepared(np.concatenate([x, z], axis=1), np.random.default_rng([seed, 0]))
        k = max(1, int(self.knn * len(v))) if self.knn < 1 else int(self.knn)
        radius = neighbours(v, k)
        near = within(v[:, x.shape[1] :], radius * 0.999999999)
        return float(digamma(near).mean() - digamma(np.array([k]))[0] + x.shape[1] * np.log(2 * np.maximum(radius, 1e-300)).mean())

    def measure(self, x, y, z, rng):
        v = self.prepared(np.concatenate([x, y, z], axis=1), rng)
        dx, dy = x.shape[1], y.shape[1]
        val = self.estimate(v, dx, dy)
        if not self.samples:
            return val, math.nan
        null = np.empty(self.samples)
        near = self.near(v[:, dx + dy :])
        for s in range(self.samples):
            w = v.copy()
            w[:, :dx] = v[self.permutation(near, rng), :dx] if near is not None else rng.permutation(v[:, :dx])
            null[s] = self.estimate(w, dx, dy)
        return val, float((null >= val).mean())

    def near(self, z: np.ndarray) -> np.ndarray | None:
        if not z.shape[1]:
            return None
        k, out = min(self.shuffle, len(z)), []
        for a in range(0, len(z), 256):
            d = np.abs(z[a : a + 256, None, :] - z[None]).max(2)
            out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
        return np.concatenate(out)

    @staticmethod
    def permutation(near: np.ndarray, rng) -> np.ndarray:
        """In random order every row takes one of its neighbours that none has taken yet, or else the last it tried."""
        n, used = len(near), np.zeros(len(near), bool)
        out = np.empty(n, np.int64)
        shuffled = rng.permuted(near, axis=1)
        for i in rng.permutation(n):
            free = shuffled[i][~used[shuffled[i]]]
            out[i] = free[0] if len(free) else shuffled[i][-1]
            used[out[i]] = True
        return out


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Of two one-dimensional samples, a block of rows of their distances at a time."""
    n = len(x)

    def mean_distances(v):
        order = np.argsort(v, kind="stable")
        w = v[order]
        total = np.cumsum(w)
        out = np.empty(n)
        out[order] = (w * (2 * np.arange(1, n + 1) - n) + total[-1] - 2 * total) / n
        return out

    parts = [(v, m := mean_distances(v), m.mean()) for v in (np.asarray(x, float), np.asarray(y, float))]
    ab = aa = bb = 0.0
    step = max(1, (1 << 18) // max(n, 1))
    for k in range(0, n, step):
        a, b = (np.abs(v[k : k + step, None] - v[None]) - m[None] - m[k : k + step, None] + g for v, m, g in parts)
        ab, aa, bb = ab + np.vdot(a, b), aa + np.vdot(a, a), bb + np.vdot(b, b)
    scale = math.sqrt(aa * bb)
    return math.sqrt(max(ab, 0) / scale) if scale > 0 else 0.0


@lru_cache(maxsize=64)
def null_distance_correlations(n: int, samples: int) -> np.ndarray:
    """Distance correlations of independent uniform samples of n rows; they shrink with n, so every n has its own."""
    rng = np.random.default_rng([n, samples])
    return np.array([distance_correlation(*rng.random((2, n))) for _ in range(samples)])


class GPDC(SampleTest):
    """Distance correlation of the ranks of Gaussian-process residuals; length scale and noise by marginal likelihood on a grid, p from independent uniform samples of as many rows."""

    name, two_sided = "gp_dc", False

    def __init__(self, samples: int = 300):
        self.samples = samples

    def fitted(self, target: np.ndarray, z: np.ndarray) -> np.ndarray:
        z = (z - z.mean(0)) / z.std(0)
        y = (target - target.mean()) / target.std()
        d = ((z[:, None] - z[None]) ** 2).sum(2)
        best, out = -math.inf, y
        for scale in (0.5, 1.0, 2.0, 4.0):
            w, v = np.linalg.eigh(np.exp(-d / (2 * scale**2 * z.shape[1])))
            proj = v.T @ y
            for noise in (0.05, 0.2, 0.5, 1.0):
                e = np.maximum(w, 0) + noise
                amount = (proj**2 / e).mean()
                like = -0.5 * len(y) * math.log(amount) - 0.5 * np.log(e).sum()
                if like > best:
                    best, out = like, v @ (noise * proj / e)
        return out

    def reduced(self, x, y, z, rng):
        a, b = x[:, 0], y[:, 0]
        if z.shape[1]:
            a, b = self.fitted(a, z), self.fitted(b, z)
        rank = lambda v: np.searchsorted(np.sort(v), v, "right") / len(v)
        return rank(a), rank(b)

    between = staticmethod(distance_correlation)

    def measure(self, x, y, z, rng):
        a, b = self.reduced(x, y, z, rng)
        val = self.between(a, b)
        return val, float(np.mean(null_distance_correlations(len(a), self.samples) > abs(val)))


def symbols(data: Data, questions: Sequence[Question]) -> DataFrame:
    """Counts (k, x, y, z, c) of the joint symbols of each question; x, y, z are structs n0, n1, ... of the nodes' values, z is 0 where there is none."""
    code = lambda nodes: F.struct(*[F.col(column(n)).alias(f"n{i}") for i, n in enumerate(nodes)]) if nodes else F.lit(0)
    shapes: dict[tuple, list[int]] = {}
    for k, q in enumerate(questions):
        shapes.setdefault((len(q.x), len(q.y), len(q.z)), []).append(k)
    if len(questions) == 1:
        (q,) = questions
        rows = data.embedding().where(data.valid(q)).select(F.lit(0).alias("k"), code(q.x).alias("x"), code(q.y).alias("y"), code(q.z).alias("z"))
        return rows.groupBy("k", "x", "y", "z").agg(F.count(F.lit(1)).alias("c"))
    text = lambda nodes: F.concat_ws(",", *[F.col(column(n)).cast("string") for n in nodes]) if nodes else F.lit("")
    if len(shapes) == 1:
        text = code
    parts = [F.when(data.valid(q), F.struct(F.lit(k).alias("k"), text(q.x).alias("x"), text(q.y).alias("y"), text(q.z).alias("z"))) for k, q in enumerate(questions)]
    return data.embedding().select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*").groupBy("k", "x", "y", "z").agg(F.count(F.lit(1)).alias("c"))


def with_margins(counts: DataFrame) -> DataFrame:
    """counts with the margins xz, yz, z and the total of each question, as sums over windows of the grouped counts."""
    keys = {"n_xz": ("k", "x", "z"), "n_yz": ("k", "y", "z"), "n_z": ("k", "z"), "n": ("k",)}
    return counts.withColumns({name: F.sum("c").over(Window.partitionBy(*by)) for name, by in keys.items()})


class CMIsymb:
    """Conditional mutual information of discrete symbols from contingency counts; p from permutations within strata of Z."""

    name, two_sided = "cmi_symb", False

    def __init__(self, samples: int = 200):
        self.samples = samples

    def run(self, data: Data, questions: Sequence[Question], seed: int = 42) -> list[Answer]:
        asked = [data.expanded(q) for q in questions]
        counts = with_margins(symbols(data, asked)).persist()
        share = F.col("c") / F.col("n")
        rows = counts.groupBy("k").agg(F.sum(share * F.log(F.col("c") * F.col("n_z") / (F.col("n_xz") * F.col("n_yz")))).alias("val"), F.max("n").alias("n")).collect()
        out = [Answer(0.0, 1.0) for _ in asked]
        for r in rows:
            out[r["k"]] = Answer(max(r["val"], 0.0), math.nan, r["n"], len(asked[r["k"]].x) + len(asked[r["k"]].y) + len(asked[r["k"]].z))
        if self.samples:
            samples = self.samples
            vals = {r["k"]: r["val"] for r in rows}

            def null(t: pa.Table) -> pa.Table:
                k = t.column("k")[0].as_py()
                rng = np.random.default_rng([seed, k])
                x, y, z = (np.unique(np.array(t.column(c).to_pylist(), object).astype(str), return_inverse=True)[1] for c in "xyz")
                table = np.zeros((z.max() + 1, x.max() + 1, y.max() + 1), np.int64)
                np.add.at(table, (z, x, y), t.column("c").to_numpy())
                more = sum(table_cmi(shuffled_table(table, rng)) >= vals[k] - 1e-12 for _ in range(samples))
                return pa.table({"k": pa.array([k], pa.int64()), "p": pa.array([more / samples])})

            for r in counts.select("k", "x", "y", "z", "c").groupBy("k").applyInArrow(null, "k long, p double").collect():
                out[r["k"]].p = r["p"]
        counts.unpersist()
        return out


def shuffled_table(table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts (z, x, y) after a random permutation of X within every z: each x in turn draws its y from what is left; the rows themselves are never made."""
    out = np.empty_like(table)
    for s, counts in enumerate(table):
        left = counts.sum(0)
        for i, n in enumerate(counts.sum(1)):
            out[s, i] = rng.multivariate_hypergeometric(left, n, method="marginals")
            left = left - out[s, i]
    return out


def table_cmi(table: np.ndarray) -> float:
    """Conditional mutual information of counts (z, x, y), in nats."""
    h = lambda c: -(c[c > 0] / table.sum() * np.log(c[c > 0] / table.sum())).sum()
    return float(h(table.sum(2)) + h(table.sum(1)) - h(table.sum((1, 2))) - h(table))


def cmi(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
    """Conditional mutual information of integer codes, in nats."""

    def h(*parts):
        c = np.unique(np.stack(parts), axis=1, return_counts=True)[1] / len(x)
        return -(c * np.log(c)).sum()

    return h(x, z) + h(y, z) - h(z) - h(x, y, z)


class GSquared:
    """Likelihood-ratio test of discrete symbols, stratum by stratum of Z."""

    name, two_sided = "gsquared", False

    def run(self, data: Data, questions: Sequence[Question]) -> list[Answer]:
        asked = [data.expanded(q) for q in questions]
        counts = with_margins(symbols(data, asked)).persist()
        g = counts.groupBy("k").agg((2 * F.sum(F.col("c") * F.log(F.col("c") * F.col("n_z") / (F.col("n_xz") * F.col("n_yz"))))).alias("val"), F.max("n").alias("n"))
        kinds = counts.groupBy("k", "z").agg(F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"))
        dof = kinds.groupBy("k").agg(F.sum((F.col("nx") - 1) * (F.col("ny") - 1)).alias("dof"))
        out = [Answer(0.0, 1.0) for _ in asked]
        for r in g.join(dof, "k").collect():
            q = asked[r["k"]]
            out[r["k"]] = Answer(r["val"], chi2_sf(r["val"], max(r["dof"], 1)), r["n"], len(q.x) + len(q.y) + len(q.z))
        counts.unpersist()
        return out


class PairwiseMultCI:
    """Vectors by their pairs of components: the largest statistic, the smallest p times the number of pairs."""

    two_sided = True

    def __init__(self, inner=None):
        self.inner = inner or ParCorr()
        self.name = f"pairwise_{self.inner.name}"

    def run(self, data: Data, questions: Sequence[Question]) -> list[Answer]:
        asked = [data.expanded(q) for q in questions]
        pairs = [(k, Question((a,), (b,), q.z)) for k, q in enumerate(asked) for a in q.x for b in q.y]
        got: dict[int, list[Answer]] = {}
        for (k, _), a in zip(pairs, self.inner.run(data, [q for _, q in pairs])):
            got.setdefault(k, []).append(a)
        best = [max(got[k], key=lambda a: abs(a.val)) for k in range(len(asked))]
        return [Answer(b.val, min(1.0, min(a.p for a in got[k]) * len(got[k])), b.n, b.dim) for k, b in enumerate(best)]


class OracleCI:
    """Answers from a known structural model: d-separation in its time-series graph.

    links: {variable: [(parent variable, lag), ...]}; hidden variables are those not in `observed`; variables in `selected` are conditioned on at every time.
    """

    name, two_sided = "oracle_ci", True

    def __init__(self, links: dict[int, Sequence], observed: Sequence[int] | None = None, selected: Sequence[int] = ()):
        plain = lambda p: p[0] if isinstance(p[0], tuple) else p
        self.parents = {j: [tuple(plain(p)[:2]) for p in ps] for j, ps in links.items()}
        self.children: dict[int, list[Node]] = {}
        for j, ps in self.parents.items():
            for i, lag in ps:
                self.children.setdefault(i, []).append((j, -lag))
        self.deep = max([0, *(-lag for ps in self.parents.values() for _, lag in ps)])
        self.observed = list(observed) if observed is not None else sorted(set(links) - set(selected))
        self.selected = list(selected)

    @classmethod
    def of_graph(cls, graph: np.ndarray) -> OracleCI:
        """Of a graph with directed and bidirected links: a hidden variable stands for each of the latter."""
        from lagweave.plans.graphs import canonical

        return cls(canonical(graph), range(len(graph)))

    def run(self, data: Data | None, questions: Sequence[Question]) -> list[Answer]:
        out = []
        for q in questions:
            dependent = self.connected(q)
            out.append(Answer(float(dependent), 1.0 - dependent))
        return out

    def named(self, node: Node) -> Node:
        return self.observed[node[0]], node[1]

    def connected(self, q: Question) -> bool:
        """Whether an open path joins X and Y given Z (Bayes ball over a window of times that is deep enough for stationarity to repeat itself)."""
        x, y, z = ({self.named(n) for n in part} for part in (q.x, q.y, q.z))
        z -= x | y
        low = min(lag for _, lag in x | y | z) - self.deep * (len(self.parents) * 2 + 2) - 1
        z |= {(v, t) for v in self.selected for t in range(low, 1)} - x - y
        above = set()  # ancestors of Z, itself included
        todo = deque(z)
        while todo:
            n = todo.popleft()
            if n in above or n[1] < low:
                continue
            above.add(n)
            todo.extend((i, n[1] + lag) for i, lag in self.parents.get(n[0], ()))
        seen, todo = set(), deque((n, True) for n in x)
        while todo:
            node, up = todo.popleft()  # up: it came from a child, or is the start
            if (node, up) in seen or not low <= node[1] <= 0:
                continue
            seen.add((node, up))
            if node in y:
                return True
            below = [(j, node[1] + k) for j, k in self.children.get(node[0], ())]
            over = [(i, node[1] + k) for i, k in self.parents.get(node[0], ())]
            if up and node not in z:
                todo.extend((n, True) for n in over)
                todo.extend((n, False) for n in below)
            elif not up:
                if node not in z:
                    todo.extend((n, False) for n in below)
                if node in above:
                    todo.extend((n, True) for n in over)
        return False
