"""Joint discovery over many datasets with shared context, and discovery of regimes in one series.

Datasets are told apart by a space dummy and times by a time dummy: vectors with an indicator for each dataset or time. No indicator
column is ever made. Conditioning on a dummy is taking off group means; an indicator's covariance with a column is its
share times the group mean's distance from the mean. So all that is read from the data is moments and group means, and the degrees of freedom
count every indicator.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators.ci import Answer, Data, ParCorr, Question, conditional
from lagweave.operators.embedding import Node, column
from lagweave.operators.moments import Moments, moments
from lagweave.sources.panel import Panel

from .models import regression
from .pcmci import Assumed, Discovery, Found, assumptions

CLASSES = ("system", "time_context", "space_context", "time_dummy", "space_dummy")


def without_means(df: DataFrame, nodes: list[Node], by: Sequence[str], rounds: int = 10) -> DataFrame:
    """df less the means of its groups; for two groupings in turns, until both means are gone (at once in balanced panels)."""
    names = [column(n) for n in nodes]
    for k in range(1 if len(by) == 1 else rounds):
        key = by[k % len(by)]
        means = df.groupBy(key).agg(*[F.avg(c).alias(f"m_{c}") for c in names])
        df = df.join(means, key).select("dataset", "t", "shared", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
        if len(by) == 2 and k == 1 and _balanced(df):
            break
    return df


def _balanced(df: DataFrame) -> bool:
    n, sets, times = df.agg(F.count(F.lit(1)), F.countDistinct("dataset"), F.countDistinct("shared")).first()
    return n == sets * times


class JointDiscovery(Discovery):
    """PCMCI+ over the pooled rows of all datasets. classes: a class (CLASSES) for each variable, system where none is given; the dummies are variables
    beyond the panel's (no column), system variables are those of interest; context causes system, never the reverse. Linear tests."""

    def __init__(self, panel: Panel, classes: dict[int, str], cut_off: str = "2xtau_max"):
        super().__init__(panel, ParCorr(), cut_off)
        if any(c not in CLASSES for c in classes.values()):
            raise ValueError(f"a class is one of {CLASSES}")
        self.classes = {j: classes.get(j, "system") for j in range(max([panel.n - 1, *classes]) + 1)}
        self.n = len(self.classes)
        pick = lambda *kinds: [j for j, c in self.classes.items() if c in kinds]
        self.system, self.context, self.dummies = pick("system"), pick("time_context", "space_context"), pick("time_dummy", "space_dummy")
        if any(j < panel.n for j in self.dummies) or any(j >= panel.n for j in (*self.system, *self.context)):
            raise ValueError("dummies, and only they, have no column")
        self._variants: dict[tuple[str, ...], tuple[DataFrame, Moments]] = {}
        self._means: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self._sizes: dict[str, int] = {}

    # -- data with dummies -----------------------------------------------------------------------------------

    def key(self, dummy: int) -> str:
        return "dataset" if self.classes[dummy] == "space_dummy" else "shared"

    def at(self, tau_max: int) -> None:
        if self.data is None or self.data.tau_max != tau_max:
            super().at(tau_max)
            self._variants, self._means, self._sizes = {}, {}, {}

    def frame(self) -> DataFrame:
        nodes = self.data.nodes()
        return self.data.embedding().dropna(subset=[column(n) for n in nodes])

    def variant(self, by: tuple[str, ...]) -> tuple[DataFrame, Moments]:
        if by not in self._variants:
            nodes = self.data.nodes()
            df = without_means(self.frame(), nodes, by) if by else self.frame()
            self._variants[by] = df, moments(df, nodes)[()]
        return self._variants[by]

    def groups(self, key: str) -> int:
        if key not in self._sizes:
            self._sizes[key] = self.frame().agg(F.countDistinct(key)).first()[0]
        return self._sizes[key]

    def means(self, by: tuple[str, ...], key: str) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the groups of key, and their means of all nodes: a row for each dataset or time."""
        if (by, key) not in self._means:
            nodes = self.data.nodes()
            rows = self.variant(by)[0].groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(column(n)).alias(column(n)) for n in nodes]).collect()
            n = np.array([r["n"] for r in rows], float)
            self._means[by, key] = n / n.sum(), np.array([[r[column(k)] for k in nodes] for r in rows], float)
        return self._means[by, key]

    def ask(self, questions: Sequence[Question]) -> list[Answer]:
        out = []
        for q in questions:
            k = (q.x, q.y, frozenset(q.z))
            if k not in self.known:
                self.known[k] = self.answer(q)
            out.append(self.known[k])
        return out

    def answer(self, q: Question) -> Answer:
        dummy = lambda n: n[0] in self.dummies
        by = tuple(sorted({self.key(n[0]) for n in q.z if dummy(n)}))
        z = [n for n in q.z if not dummy(n)]
        _, m = self.variant(by)
        extra = sum(self.groups(k) for k in by)
        (x,), (y,) = q.x, q.y
        if dummy(x) == dummy(y) == True:  # noqa: E712
            return Answer(0.0, 1.0, m.n)
        if not dummy(x) and not dummy(y):
            a = ParCorr().answer(m, Question((x,), (y,), tuple(z)))
            return Answer(a.val, ParCorr.p_value(a.val, m.n, a.dim + extra) if m.part([x, y]).diagonal().min() > 0 else 1.0, m.n, a.dim + extra)
        d, other = (x, y) if dummy(x) else (y, x)
        share, means = self.means(by, self.key(d[0]))
        at = m.at([other, *z])
        cross = share[:, None] * (means[:, at] - m.mean[at])
        own = share * (1 - share)
        rest = conditional(m, [other], z)[0, 0]
        if len(z):
            inner = m.part(z)
            coef = np.linalg.lstsq(inner, cross[:, 1:].T, rcond=1e-12)[0].T
            own = own - (coef * cross[:, 1:]).sum(1)
            cross0 = cross[:, 0] - coef @ m.cov[at[1:], at[0]]
        else:
            cross0 = cross[:, 0]
        ok = (own > 1e-12) & (rest > 0)
        r = np.clip(np.where(ok, cross0 / np.sqrt(np.maximum(own * rest, 1e-300)), 0.0), -1, 1)
        val = float(r[np.abs(r).argmax()])
        dim = 1 + len(share) + len(z) + extra
        return Answer(val, min(1.0, ParCorr.p_value(val, m.n, dim) * len(share)), m.n, dim)

    # -- search --------------------------------------------------------------------------------------------

    def allowed(self, tau_min: int, tau_max: int, links: Assumed | None) -> Assumed:
        """Links that context and dummies leave possible: none into a dummy, from system to context, between kinds of context, or lagged from what doesn't change in time."""
        out = assumptions(self.n, tau_min, tau_max, links)
        kind = self.classes
        for j in out:
            for (i, lag), mark in list(out[j].items()):
                pair = kind[i], kind[j]
                gone = j in self.dummies or (lag and (i in self.dummies or kind[i] == "space_context")) or (j in self.context and i in self.system) or (j in self.context and i == j and lag == 0)
                gone |= set(pair) == {"time_context", "space_context"} or (j in self.context and i in self.dummies)
                if j in self.system and (i in self.context or i in self.dummies):
                    out[j][i, lag] = f"-{mark[1]}>"
                if gone:
                    del out[j][i, lag]
        for j in out:  # what points into system is seen from both sides
            for i in (*self.context, *self.dummies):
                if (j, 0) in out[i] and j in self.system:
                    out[i][j, 0] = "<" + out[j][i, 0][1] + "-"
        return out

    def graph_with(self, assumed: Assumed, tau_max: int, open_: Sequence[int], parents: dict[int, list[Node]], drop: Sequence[int] = ()) -> np.ndarray:
        """Links as a graph of which only those from the open variables (all, if none is given) are to be tested."""
        graph = np.full((self.n, self.n, tau_max + 1), "", dtype="<U3")
        for j in range(self.n):
            for (i, lag), mark in assumed[j].items():
                if i in drop or j in drop or (lag and (i, lag) not in parents[j]):
                    continue
                graph[i, j, -lag] = mark if not open_ or i in open_ else mark.replace("?", "-")
                if lag == 0 and i in (*self.context, *self.dummies) and j in self.system:
                    graph[j, i, 0] = "<--"  # tested from the outer side only
        return graph

    def run_jpcmciplus(self, tau_max: int, tau_min: int = 0, pc_alpha: float = 0.01, colliders: str = "majority", conflicts: bool = True, max_conds_px: int | None = None, max_conds_py: int | None = None, links: Assumed | None = None, max_combinations: int = 1) -> Found:
        """Lagged parents; links from context; links from dummies, given those; links of the system, given all; orientation."""
        self.at(tau_max)
        assumed = self.allowed(tau_min, tau_max, links)
        plain = {j: {n: m for n, m in own.items() if n[0] not in self.dummies} for j, own in assumed.items() if j not in self.dummies}
        lagged, val, p = self.parents(tau_max, max(1, tau_min), pc_alpha, None, max_combinations, plain | {j: {} for j in self.dummies})
        found_context = {j: [] for j in range(self.n)}
        found_dummy = {j: [] for j in range(self.n)}
        args = pc_alpha, tau_max
        if self.context:
            found = self.skeleton(self.graph_with(assumed, tau_max, self.context, lagged, drop=self.dummies), lagged, *args, val, p, max_conds_px, max_conds_py, contemporaneous=True)
            val, p = found.val, found.p
            found_context |= {j: [(c, -t) for c in self.context for t in range(tau_max + 1) if found.graph[c, j, t] in ("-->", "o-o")] for j in self.system}
        lagged = {j: [n for n in own if n[0] not in self.context] for j, own in lagged.items()}
        if self.dummies:
            given = {j: list(dict.fromkeys([*found_context[j], *lagged[j]])) for j in range(self.n)}
            found = self.skeleton(self.graph_with(assumed, tau_max, self.dummies, lagged, drop=self.context), given, *args, val, p, max_conds_px, max_conds_py, contemporaneous=True)
            for d in self.dummies:
                val[d], p[d] = found.val[d], found.p[d]
                val[:, d], p[:, d] = found.val[:, d], found.p[:, d]
            found_dummy |= {j: [(d, 0) for d in self.dummies if found.graph[d, j, 0] == "-->"] for j in self.system}
        given = {j: list(dict.fromkeys([*found_dummy[j], *found_context[j], *lagged[j]])) for j in range(self.n)}
        inner = {j: {n: m for n, m in own.items() if n[0] in self.system} if j in self.system else {} for j, own in assumed.items()}
        graph = self.graph_with(inner, tau_max, (), lagged)
        found = self.skeleton(graph, given, *args, val, p, max_conds_px, max_conds_py, contemporaneous=True)
        for j in self.system:
            for i, lag in (*found_context[j], *found_dummy[j]):
                found.graph[i, j, -lag] = "-->"
                if lag == 0:
                    found.graph[j, i, 0] = "<--"
        outer = [*self.context, *self.dummies]
        for c in outer:
            found.val[c], found.p[c], found.val[:, c], found.p[:, c] = val[c], p[c], val[:, c], p[:, c]
        self.orient_colliders(found, colliders, conflicts, given, pc_alpha, max_conds_px, max_conds_py)
        self.apply_rules(found, conflicts)
        found.parents = given
        return found

    def question(self, i: int, lag: int, j: int, s, parents, max_px, max_py) -> Question:
        q = super().question(i, lag, j, s, parents, max_px, max_py)
        still = lambda n: (n[0], 0) if n[0] in self.dummies or self.classes[n[0]] == "space_context" else n  # noqa: E731  dummies and what is constant in time have no lag
        z = dict.fromkeys(still(n) for n in q.z)
        return Question(q.x, q.y, tuple(n for n in z if n not in (*q.x, *q.y)))


@dataclass
class Regimes:
    """Best annealing: the regime of each time, each regime's graph, and how the objective went."""

    times: DataFrame
    found: dict[int, Found]
    objective: float
    steps: list[float]


def persistent_path(cost: np.ndarray, switches: int) -> tuple[np.ndarray, float]:
    """The cheapest sequence of regimes for cost (regimes, times) with at most so many switches in all; exact, by dynamic programming."""
    k, n = cost.shape
    switches = min(switches, max(0, n - 1))
    best = np.full((switches + 1, k), np.inf)
    best[0] = cost[:, 0]
    came = np.zeros((n, switches + 1, k), np.int16)  # the regime before
    for t in range(1, n):
        change = np.full_like(best, np.inf)
        source = np.zeros((switches + 1, k), np.int64)
        if switches and k > 1:
            order = np.argsort(best[:-1], axis=1, kind="stable")[:, :2]
            for r in range(k):
                pick = np.where(order[:, 0] == r, order[:, 1], order[:, 0])
                source[1:, r] = pick
                change[1:, r] = best[np.arange(switches), pick]
        stay = best <= change
        came[t] = np.where(stay, np.arange(k)[None], source)
        best = np.where(stay, best, change) + cost[:, t]
    s, r = np.unravel_index(best.argmin(), best.shape)
    total, path = float(best[s, r]), np.empty(n, np.int64)
    for t in range(n - 1, -1, -1):
        path[t] = r
        if t:
            before = int(came[t, s, r])
            s, r = s - (before != r), before
    return path, total


class RegimeDiscovery:
    """Regimes of one series, each with its own graph: in turns, the graph and a linear model of each regime, and the cheapest persistent sequence of regimes given
    the models' squared errors. All annealings (random starts) go through the same two passes over the data in each turn.

    The sequence is one of whole regimes with at most regimes * max_transitions / 2 switches in all: a switch ends one regime and begins another."""

    def __init__(self, panel: Panel, seed: int = 0):
        if panel.vectors or panel.masked:
            raise ValueError("one series without vectors and masks")
        self.panel, self.seed = panel, seed

    def run_rpcmci(self, regimes: int, max_transitions: int, tau_max: int = 1, tau_min: int = 1, switch_thres: float = 0.05, iterations: int = 20, annealings: int = 10, pc_alpha: float = 0.2, alpha: float = 0.01) -> Regimes | None:
        base = Data(self.panel, tau_max)
        frame, nodes, n = base.embedding(), base.nodes(), self.panel.n
        total = frame.agg(F.countDistinct("dataset"), F.count(F.lit(1))).first()
        if total[0] != 1:
            raise ValueError("one series without vectors and masks")
        spark = frame.sparkSession
        live = list(range(annealings))
        # at the start a row belongs to each regime by chance
        chance = lambda a, k: (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(a), F.lit(k), "t"), F.lit(1 << 20)) / (1 << 20)) > switch_thres
        member = frame.select("t").withColumn("runs", F.filter(F.array(*[F.when(chance(a, k), F.lit(a * regimes + k)) for a in live for k in range(regimes)]), lambda x: x.isNotNull()))
        paths, found, steps, objective = None, {}, {a: [] for a in live}, {}
        while live and iterations > 0:
            iterations -= 1
            rows = frame.join(member, "t").withColumn("run", F.explode("runs"))
            got = {int(r): m for (r,), m in moments(rows, nodes, ["run"]).items()}
            models = {}
            for a in list(live):
                own = {k: got.get(a * regimes + k) for k in range(regimes)}
                if any(m is None or m.n <= 5 for m in own.values()):
                    live.remove(a)
                    found.pop(a, None)
                    continue
                found[a] = {}
                for k, m in own.items():
                    part = Data(self.panel, tau_max, frame=frame)
                    part._nodes, part._whole, part._gaps = set(nodes), {(): m}, False
                    d = Discovery(self.panel, ParCorr())
                    d.data = part
                    found[a][k] = d.run_pcmci(tau_max, tau_min, pc_alpha, alpha)
                    parents = {j: sorted((i, -t) for i, t in zip(*np.nonzero(found[a][k].graph[:, j] == "-->"))) for j in range(n)}
                    models[a, k] = {j: (parents[j], *regression(m, (j, 0), parents[j])) for j in range(n)}
            if not live:
                break
            table = self.errors(frame, nodes, models)
            limit = regimes * max_transitions // 2

            def choose(t: pa.Table) -> pa.Table:
                t = t.sort_by("t")
                cost = np.stack([t.column(f"e{k}").to_numpy() for k in range(regimes)])
                path, total = persistent_path(cost, limit)
                return pa.table({"a": t.column("a"), "t": t.column("t"), "regime": path, "total": np.full(len(path), total)})

            fresh = table.groupBy("a").applyInArrow(choose, "a long, t long, regime long, total double").persist()
            for r in fresh.groupBy("a").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("rows")).collect():
                objective[r["a"]] = r["total"]
            moved = {a: float(total[1]) for a in live}
            if paths is not None:
                change = fresh.join(paths.withColumnRenamed("regime", "was").select("a", "t", "was"), ["a", "t"]).groupBy("a").agg(F.count_if(F.col("regime") != F.col("was")).alias("moved"))
                moved |= {r["a"]: 2.0 * r["moved"] for r in change.collect()}
            for a in list(live):
                steps[a].append(moved[a])
                if moved[a] == 0 or (len(steps[a]) > 5 and moved[a] <= 2 * regimes * total[1] // 100):
                    live.remove(a)
            old = paths
            paths = fresh if old is None else fresh.unionAll(old.join(fresh.select("a").distinct(), "a", "left_anti"))
            paths = spark.createDataFrame(paths.toArrow().cast(pa.schema([("a", pa.int64()), ("t", pa.int64()), ("regime", pa.int64()), ("total", pa.float64())])))  # a row for each time and annealing; cuts the lineage
            fresh.unpersist()
            member = paths.where(F.col("a").isin(live) if live else F.lit(False)).groupBy("t").agg(F.collect_list((F.col("a") * regimes + F.col("regime")).cast("int")).alias("runs"))
        done = [a for a in found if a in objective]
        if not done:
            return None
        best = min(done, key=lambda a: (objective[a], a))
        base.release()
        return Regimes(paths.where(F.col("a") == best).select("t", "regime"), found[best], objective[best], steps[best])

    def errors(self, frame: DataFrame, nodes: list[Node], models: dict) -> DataFrame:
        """(a, t, e0, e1, ...): the squared errors of all variables under each regime's model, one row for each annealing and time."""
        runs = sorted({a for a, _ in models})
        regimes = sorted({k for _, k in models})
        parts = []
        for a in runs:
            sums = []
            for k in regimes:
                e = F.lit(0.0)
                for j, (parents, coef, base) in models[a, k].items():
                    guess = F.lit(float(base))
                    for node, c in zip(parents, coef):
                        guess = guess + F.col(column(node)) * F.lit(float(c))
                    rest = F.col(column((j, 0))) - guess
                    e = e + rest * rest
                sums.append(e.alias(f"e{k}"))
            parts.append(F.struct(F.lit(a).cast("long").alias("a"), *sums))
        return frame.dropna(subset=[column(n) for n in nodes]).select("t", F.explode(F.array(*parts)).alias("r")).select("r.a", "t", *[f"r.e{k}" for k in regimes])
