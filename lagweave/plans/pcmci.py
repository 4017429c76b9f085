"""Causal discovery for stationary time series: lagged parent selection, momentary tests, contemporaneous orientation.

The search over graphs is a small program on the driver. It asks its questions in batches, as many as
do not depend on one another's answers, and replays the decisions in their fixed order, so the
cluster sees a few wide jobs instead of thousands of small ones. Answers are kept by question.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations, islice, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators.ci import Answer, Data, ParCorr, Question
from lagweave.operators.embedding import Node
from lagweave.operators.links import LINKS, fdr_values, summary, to_links
from lagweave.operators.moments import moments, numbered, resampled_moments
from lagweave.sources.panel import Panel

ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
PLUS_ALPHAS = (0.001, 0.005, 0.01, 0.025, 0.05)
Assumed = dict[int, dict[Node, str]]


@dataclass
class Found:
    """Result of a run: matrices (i, j, tau), and what only some methods give."""

    val: np.ndarray
    p: np.ndarray
    graph: np.ndarray
    parents: dict[int, list[Node]] = field(default_factory=dict)
    sepsets: dict = field(default_factory=dict)
    ambiguous: list = field(default_factory=list)
    conf: np.ndarray | None = None

    def links(self, spark) -> DataFrame:
        return to_links(spark, self.val, self.p, self.graph)


def assumptions(n: int, tau_min: int, tau_max: int, given: Assumed | None = None) -> Assumed:
    """Links to search: all of them as '-?>' (at lag 0 'o?o'), or the given ones, checked."""
    if not 0 <= tau_min <= tau_max:
        raise ValueError("0 <= tau_min <= tau_max")
    if given is None:
        return {j: {(i, -t): "o?o" if t == 0 else "-?>" for i in range(n) for t in range(tau_min, tau_max + 1) if (i, t) != (j, 0)} for j in range(n)}
    out: Assumed = {j: {} for j in range(n)}
    for j, links in given.items():
        for (i, lag), mark in links.items():
            if mark not in ("o-o", "o?o", "-->", "-?>", "<--", "<?-", "") or lag > 0 or not 0 <= i < n:
                raise ValueError(f"no such link: {(i, lag)} {mark} {j}")
            if mark and tau_min <= -lag <= tau_max and (i, lag) != (j, 0):
                out[j][(i, lag)] = f"-{mark[1]}>" if lag else mark
    for j in range(n):
        for (i, lag), mark in list(out[j].items()):
            if lag == 0:
                back = {"<": ">", ">": "<"}.get(mark[2], mark[2]) + mark[1] + {"<": ">", ">": "<"}.get(mark[0], mark[0])
                if out[i].setdefault((j, 0), back) != back:
                    raise ValueError(f"links of {i} and {j} at lag 0 differ")
    if _cyclic({j: [i for (i, lag), m in out[j].items() if lag == 0 and m in ("-->", "-?>")] for j in range(n)}):
        raise ValueError("contemporaneous links form a cycle")
    return out


def _cyclic(parents: dict[int, Iterable[int]]) -> bool:
    left = {j: set(p) for j, p in parents.items()}
    while left:
        free = [j for j, p in left.items() if not p & set(left)]
        if not free:
            return True
        for j in free:
            del left[j]
    return False


class Discovery:
    def __init__(self, panel: Panel, test=None, cut_off: str = "2xtau_max", mask_type: str | None = None):
        self.panel, self.test, self.cut_off, self.mask_type = panel, test or ParCorr(), cut_off, mask_type
        self.n = panel.n if not panel.vectors else max(panel.vectors) + 1
        self.data: Data | None = None
        self.known: dict[tuple, Answer] = {}

    # -- questions ------------------------------------------------------------------------------

    def at(self, tau_max: int) -> None:
        if self.data is None or self.data.tau_max != tau_max:
            if self.data is not None:
                self.data.release()
            self.data, self.known = Data(self.panel, tau_max, self.cut_off, self.mask_type), {}

    def ask(self, questions: Sequence[Question]) -> list[Answer]:
        key = lambda q: (q.x, q.y, frozenset(q.z))
        fresh = list({key(q): q for q in questions if key(q) not in self.known}.values())
        if fresh:
            self.known |= {key(q): a for q, a in zip(fresh, self.test.run(self.data, fresh))}
        return [self.known[key(q)] for q in questions]

    # -- lagged parents -------------------------------------------------------------------------

    def parents(self, tau_max: int, tau_min: int = 1, alpha: float | Sequence[float] | None = 0.2, max_conds_dim: int | None = None, max_combinations: int = 1, links: Assumed | None = None) -> tuple[dict[int, list[Node]], np.ndarray, np.ndarray]:
        """PC1: for each variable its lagged parents, strongest first; with several alphas the one whose parents score best. Also the values and largest p of all candidates."""
        self.at(tau_max)
        grid = list(ALPHAS) if alpha is None else [alpha] if np.isscalar(alpha) else list(alpha)
        assumed = assumptions(self.n, max(tau_min, 1), tau_max, links)
        most = self.n * (tau_max - tau_min + 1) if max_conds_dim is None else max_conds_dim
        runs = {(j, a): _Selection(j, a, assumed[j]) for j in range(self.n) for a in grid}
        for dim in range(most + 1):
            asked = {k: r.questions(dim, max_combinations) for k, r in runs.items() if len(r.order) - 1 >= dim}
            if not asked:
                break
            self.ask([q for sets in asked.values() for part in sets.values() for q in part])
            for k, sets in asked.items():
                runs[k].decide(sets, self.ask)
        val, p = np.zeros((self.n, self.n, tau_max + 1)), np.ones((self.n, self.n, tau_max + 1))
        chosen = {}
        for j in range(self.n):
            best = min(grid, key=lambda a: self.test.score(self.data, (j, 0), runs[j, a].order)) if len(grid) > 1 else grid[0]
            run = runs[j, best]
            chosen[j] = run.order
            for (i, lag), x in run.p_max.items():
                val[i, j, -lag], p[i, j, -lag] = run.val_at[i, lag], x
        return chosen, val, p

    # -- momentary conditional independence -------------------------------------------------------

    def momentary(self, tau_max: int, tau_min: int = 0, parents: dict[int, list[Node]] | None = None, max_conds_py: int | None = None, max_conds_px: int | None = None, alpha: float = 0.05, fdr: bool = False, links: Assumed | None = None, kind: str = "mci", conf: float | None = None, fdr_contemporaneous: bool = False) -> Found:
        """One test for each link. kind: mci (parents of both sides), bivci (own past), fullci (whole past), pair (nothing). fdr corrects over the lagged links, or all."""
        self.at(tau_max)
        parents = parents or {}
        assumed = assumptions(self.n, tau_min, tau_max, links)
        at, questions = [], []
        for j in range(self.n):
            for (i, lag), mark in assumed[j].items():
                if kind == "mci":
                    z = [x for x in parents.get(j, [])[:max_conds_py] if x != (i, lag)] + [(k, lag + s) for k, s in parents.get(i, [])[:max_conds_px]]
                elif kind == "bivci":
                    z = [(j, -t) for t in range(max(1, tau_min), tau_max + 1) if (j, -t) != (i, lag)]
                elif kind == "fullci":
                    z = [(k, -t) for k in range(self.n) for t in range(max(1, tau_min), tau_max + 1) if (k, -t) != (i, lag)]
                else:
                    z = []
                z = [x for x in dict.fromkeys(z) if x not in ((i, lag), (j, 0))]
                at.append((i, j, -lag, mark))
                questions.append(Question(((i, lag),), ((j, 0),), tuple(z)))
        answers = self.ask(questions)
        shape = (self.n, self.n, tau_max + 1)
        val, p, bounds = np.zeros(shape), np.ones(shape), np.zeros((*shape, 2)) if conf else None
        for (i, j, t, mark), a in zip(at, answers):
            sure = mark in ("-->", "<--", "o-o") and links is not None and "?" not in mark
            val[i, j, t], p[i, j, t] = (1.0, 0.0) if sure else (a.val, a.p)
            if a.conf is not None and conf:
                bounds[i, j, t] = a.conf
            elif conf:
                bounds[i, j, t] = ParCorr.confidence(a.val, a.n, a.dim, conf)
        counted = np.zeros(shape, bool)
        for i, j, t, _ in at:
            counted[i, j, t] = t > 0 or fdr_contemporaneous
        q = fdr_values(p, counted) if fdr else p
        val, q = self.symmetrised(val, q)
        return Found(val, q, self.graph_of(q, alpha, tau_min), dict(parents), conf=bounds)

    @staticmethod
    def symmetrised(val: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        val, p = val.copy(), p.copy()
        for i, j in combinations(range(len(p)), 2):
            a, b = (i, j) if p[i, j, 0] >= p[j, i, 0] else (j, i)
            p[i, j, 0] = p[j, i, 0] = p[a, b, 0]
            val[i, j, 0] = val[j, i, 0] = val[a, b, 0]
        return val, p

    @staticmethod
    def graph_of(p: np.ndarray, alpha: float, tau_min: int = 0) -> np.ndarray:
        graph = np.full(p.shape, "", dtype="<U3")
        graph[:, :, 1:][p[:, :, 1:] <= alpha] = "-->"
        if tau_min == 0:
            both = (p[:, :, 0] <= alpha) & (p[:, :, 0].T <= alpha)
            np.fill_diagonal(both, False)
            graph[:, :, 0][both] = "o-o"
        return graph

    def run_pcmci(self, tau_max: int, tau_min: int = 0, pc_alpha=0.2, alpha: float = 0.05, fdr: bool = False, links: Assumed | None = None, max_conds_px: int | None = None, max_conds_py: int | None = None, max_combinations: int = 1, max_conds_dim: int | None = None, conf: float | None = None) -> Found:
        parents, _, _ = self.parents(tau_max, max(1, tau_min), pc_alpha, max_conds_dim, max_combinations, links)
        return self.momentary(tau_max, tau_min, parents, max_conds_py, max_conds_px, alpha, fdr, links, conf=conf)

    # -- contemporaneous links -----------------------------------------------------------------------

    def run_pcmciplus(self, tau_max: int, tau_min: int = 0, pc_alpha: float | Sequence[float] | None = 0.01, colliders: str = "majority", conflicts: bool = True, max_conds_px: int | None = None, max_conds_py: int | None = None, max_conds_px_lagged: int | None = None, fdr: bool = False, links: Assumed | None = None, max_combinations: int = 1) -> Found:
        """Lagged parents, skeleton over contemporaneous conditions, colliders, orientation rules. With several alphas the graph whose models score best."""
        if pc_alpha is None or not np.isscalar(pc_alpha):
            runs = [self.run_pcmciplus(tau_max, tau_min, a, colliders, conflicts, max_conds_px, max_conds_py, max_conds_px_lagged, fdr, links, max_combinations) for a in (PLUS_ALPHAS if pc_alpha is None else pc_alpha)]
            return min(runs, key=self.graph_score)
        parents, val, p = self.parents(tau_max, 1, pc_alpha, None, max_combinations, links)
        assumed = assumptions(self.n, tau_min, tau_max, links)
        graph = np.full((self.n, self.n, tau_max + 1), "", dtype="<U3")
        for j in range(self.n):
            for (i, lag), mark in assumed[j].items():
                if lag == 0 or (i, lag) in parents[j]:
                    graph[i, j, -lag] = mark
        found = self.skeleton(graph, parents, pc_alpha, tau_max, val, p, max_conds_px, max_conds_py, contemporaneous=True)
        self.orient_colliders(found, colliders, conflicts, parents, pc_alpha, max_conds_px, max_conds_py)
        self.apply_rules(found, conflicts)
        if fdr:
            counted = np.zeros(found.p.shape, bool)
            counted[:, :, 1:] = True
            found.p = fdr_values(found.p, counted)
        found.parents = parents
        return found

    def run_pc(self, tau_max: int = 0, tau_min: int = 0, pc_alpha: float = 0.05, colliders: str = "none", conflicts: bool = True) -> Found:
        """The PC algorithm on time series (or plain rows with tau_max 0): conditions from all adjacencies."""
        self.at(tau_max)
        graph = np.full((self.n, self.n, tau_max + 1), "", dtype="<U3")
        for j, links in assumptions(self.n, tau_min, tau_max).items():
            for (i, lag), mark in links.items():
                graph[i, j, -lag] = mark
        none = {j: [] for j in range(self.n)}
        found = self.skeleton(graph, none, pc_alpha, tau_max, np.zeros(graph.shape), np.zeros(graph.shape), None, None, contemporaneous=False)
        self.orient_colliders(found, colliders, conflicts, none, pc_alpha, None, None, contemporaneous=False)
        self.apply_rules(found, conflicts)
        return found

    def question(self, i: int, lag: int, j: int, s: Iterable[Node], parents, max_px, max_py) -> Question:
        z = [*s, *[x for x in parents[j][:max_py] if x != (i, lag)], *[(k, lag + t) for k, t in parents[i][:max_px]]]
        return Question(((i, lag),), ((j, 0),), tuple(x for x in dict.fromkeys(z) if x not in ((i, lag), (j, 0))))

    @staticmethod
    def adjacent(graph: np.ndarray, strength: np.ndarray, contemporaneous: bool) -> dict[int, list[Node]]:
        out = {}
        for j in range(len(graph)):
            own = [(i, -t) for i in range(len(graph)) for t in range(1 if contemporaneous else graph.shape[2]) if graph[i, j, t] != ""]
            out[j] = sorted(own, key=lambda n: -abs(strength[n[0], j, -n[1]]))
        return out

    def skeleton(self, graph, parents, alpha, tau_max, val, p, max_px, max_py, contemporaneous: bool, most_sets: int | None = None) -> Found:
        """Removes links whose ends some set of adjacencies of the later end separates; adjacencies are frozen within a round, removals are not."""
        strength = np.full(graph.shape, np.inf)
        val, p = val.copy(), p.copy()
        p[graph != ""] = 0
        sepsets: dict = {}
        order = [(i, j, t) for i, j in product(range(self.n), repeat=2) for t in range(graph.shape[2]) if (i, t) != (j, 0)]
        dim = 0
        while True:
            near = self.adjacent(graph, strength, contemporaneous)
            jobs = []
            for i, j, t in order:
                if graph[i, j, t] == "" or graph[i, j, t][1] != "?":
                    continue
                others = [x for x in near[j] if x != (i, -t)]
                if len(others) >= dim:
                    jobs.append((i, j, t, [(s, self.question(i, -t, j, s, parents, max_px, max_py)) for s in islice(combinations(others, dim), most_sets)]))
            if not jobs:
                break
            self.ask([q for *_, sets in jobs for _, q in sets])
            for i, j, t, sets in jobs:
                if graph[i, j, t] == "":
                    continue
                for s, q in sets:
                    a = self.ask([q])[0]
                    ends = [(i, j), (j, i)] if t == 0 else [(i, j)]
                    for x, y in ends:
                        strength[x, y, t] = min(strength[x, y, t], abs(a.val))
                        if a.p >= p[x, y, t]:
                            p[x, y, t], val[x, y, t] = a.p, a.val
                    if not a.p <= alpha:
                        for x, y in ends:
                            graph[x, y, t] = ""
                            sepsets[(x, -t), y] = s
                        break
            dim += 1
        open_ = np.char.find(graph, "?") >= 0
        if open_.any():
            graph[open_] = np.char.replace(graph[open_], "?", "-")
        return Found(val, p, graph, sepsets=sepsets)

    @staticmethod
    def triples(graph: np.ndarray) -> list[tuple[Node, int, int]]:
        """Unshielded (i, -t) --> k o-o j or (i, 0) o-o k o-o j."""
        n, out = len(graph), []
        for k, i in product(range(n), repeat=2):
            for t in range(graph.shape[2]):
                if (i, t) == (k, 0) or graph[i, k, t] == "" or (t == 0 and graph[i, k, 0] not in ("o-o", "-->")):
                    continue
                for j in range(n):
                    if graph[j, k, 0] == "o-o" and j != k and (i, t) != (j, 0) and graph[i, j, t] == "" and not (t == 0 and graph[i, k, 0] == "o-o" and i > j):
                        out.append(((i, -t), k, j))
        return out

    def orient_colliders(self, found: Found, rule: str, conflicts: bool, parents, alpha, max_px, max_py, contemporaneous: bool = True) -> None:
        graph, triples = found.graph, self.triples(found.graph)
        heads = []
        if rule == "none":
            heads = [x for x in triples if (x[1], 0) not in found.sepsets.get((x[0], x[2]), ())]
        else:
            near = self.adjacent(graph, found.val, contemporaneous)
            sets = {}
            for (i, lag), k, j in triples:
                pools = [[x for x in near[j] if x != (i, lag)]] + ([[x for x in near[i] if x != (j, 0)]] if lag == 0 else [])
                subsets = dict.fromkeys(s for pool in pools for d in range(len(pool) + 1) for s in combinations(pool, d) if pool)
                sets[(i, lag), k, j] = [(s, self.question(i, lag, j, s, parents, max_px, max_py)) for s in subsets]
            self.ask([q for part in sets.values() for _, q in part])
            for triple, part in sets.items():
                apart = [s for (s, q) in part if not self.ask([q])[0].p <= alpha]
                share = np.mean([(triple[1], 0) in s for s in apart]) if apart else None
                limit = 0 if rule == "conservative" else 0.5
                if share is None or (rule == "conservative" and 0 < share < 1) or (rule == "majority" and share == 0.5):
                    found.ambiguous.append(triple)
                elif share <= limit if rule == "conservative" else share < limit:
                    heads.append(triple)
        directed = {(i, k) for (i, lag), k, _ in heads if lag == 0 and graph[i, k, 0] == "-->"}
        for (i, lag), k, j in heads:
            if lag == 0 and (i, k) not in directed:
                self.head(graph, i, k, conflicts)
            self.head(graph, j, k, conflicts)

    @staticmethod
    def head(graph: np.ndarray, i: int, j: int, conflicts: bool) -> None:
        """Orients i --> j at lag 0; a link that already points back becomes a conflict."""
        now = graph[i, j, 0]
        if now == "o-o":
            graph[i, j, 0], graph[j, i, 0] = "-->", "<--"
        elif now == "<--" and conflicts:
            graph[i, j, 0] = graph[j, i, 0] = "x-x"

    def apply_rules(self, found: Found, conflicts: bool) -> None:
        g, n = found.graph, self.n
        unclear = {(a, k, j) for a, k, j in found.ambiguous} | {((j, 0), k, a[0]) for a, k, j in found.ambiguous if a[1] == 0}
        into = lambda i, t, j: g[i, j, t] == "-->"
        lags = range(g.shape[2])
        while True:
            one = [(k, j) for i, k, j in product(range(n), repeat=3) for t in lags if k != j and (i, t) not in ((k, 0), (j, 0)) and into(i, t, k) and g[k, j, 0] == "o-o" and g[i, j, t] == "" and ((i, -t), k, j) not in unclear]
            two = [(i, j) for i, k, j in product(range(n), repeat=3) if len({i, k, j}) == 3 and into(i, 0, k) and into(k, 0, j) and g[i, j, 0] == "o-o"] if not one else []
            three = (
                [(i, j) for i, k, l_, j in product(range(n), repeat=4) if k < l_ and len({i, k, l_, j}) == 4 and g[i, j, 0] == g[i, k, 0] == g[i, l_, 0] == "o-o" and into(k, 0, j) and into(l_, 0, j) and g[k, l_, 0] == "" and ((k, 0), i, l_) not in unclear]
                if not one and not two
                else []
            )
            todo = list(dict.fromkeys(one or two or three))
            if not todo:
                return
            for i, j in todo:
                if g[i, j, 0] in ("o-o", "<--"):
                    self.head(g, i, j, conflicts)

    def graph_score(self, found: Found) -> float:
        """Mean score of all variables' models in one directed graph of the class, variables of strong links first."""
        order = sorted(range(self.n), key=lambda j: -np.abs(found.val[:, j]).sum())
        g = directed_member(found.graph, order)
        return float(np.mean([self.test.score(self.data, (j, 0), [(i, -t) for i in range(self.n) for t in range(g.shape[2]) if g[i, j, t] == "-->"]) for j in range(self.n)]))

    # -- repeated runs --------------------------------------------------------------------------------

    def repeated(self, parts: dict[str, Data], method: str, **args) -> dict[str, Found]:
        out = {}
        for name, data in parts.items():
            own = Discovery(self.panel, self.test, self.cut_off, self.mask_type)
            own.data = data
            out[name] = getattr(own, method)(**args)
        return out

    def _parts(self, df: DataFrame, tau_max: int) -> dict[str, Data]:
        """One Data for each value of df's column `run`; for linear tests from one grouped pass."""
        base = Data(self.panel, tau_max, self.cut_off, self.mask_type)
        nodes = base.nodes()
        if hasattr(self.test, "answer") and not base.gaps():
            out = {}
            for (run,), m in sorted(moments(df, nodes, ["run"]).items()):
                own = Data(self.panel, tau_max, self.cut_off, self.mask_type, frame=base.frame)
                own._nodes, own._whole, own._gaps = set(nodes), {(): m}, False
                out[run] = own
            return out
        df = df.persist()  # read once for each run; released with the session's cache
        out = {}
        for r in df.select("run").distinct().orderBy("run").collect():  # one row for each window or sample
            own = Data(self.panel, tau_max, self.cut_off, self.mask_type, frame=df.where(F.col("run") == r["run"]).drop("run"))
            own._nodes = set(nodes)
            out[str(r["run"])] = own
        return out

    def windows(self, method: str, step: int, length: int, tau_max: int, **args) -> dict[str, Found]:
        """The method on sliding windows of anchor times: starts 0, step, ... while start < last time + 1 - length."""
        base = Data(self.panel, tau_max, self.cut_off, self.mask_type)
        df = windowed(base.embedding(), "shared", step, length)
        runs = self.repeated(self._parts(df, tau_max), method, tau_max=tau_max, **args)
        base.release()
        return runs

    def bootstrap(self, method: str, tau_max: int, samples: int = 100, block: int = 1, seed: int = 0, **args) -> dict[str, Found]:
        """The method on block-bootstrap samples of the anchor times."""
        base = Data(self.panel, tau_max, self.cut_off, self.mask_type)
        if hasattr(self.test, "answer") and not base.gaps():
            parts = {}
            for run, m in sorted(resampled_moments(base.embedding(), base.nodes(), samples, block, seed).items()):
                parts[run] = own = Data(self.panel, tau_max, self.cut_off, self.mask_type, frame=base.frame)
                own._nodes, own._whole, own._gaps = set(base.nodes()), {(): m}, False
        else:
            parts = self._parts(resampled(base.embedding(), samples, block, seed), tau_max)
        runs = self.repeated(parts, method, tau_max=tau_max, **args)
        base.release()
        return runs

    def summarised(self, runs: dict[str, Found], level: float = 0.9) -> DataFrame:
        rows = [(int(i), int(j), int(t), float(f.val[i, j, t]), float(f.p[i, j, t]), str(f.graph[i, j, t])) for f in runs.values() for i, j, t in np.ndindex(f.val.shape) if (i, t) != (j, 0)]
        return summary(self.panel.df.sparkSession.createDataFrame(rows, LINKS + ", link string"), level)


def directed_member(graph: np.ndarray, order: Sequence[int] | None = None) -> np.ndarray:
    """One directed graph of the class that a partly directed graph stands for: again and again a variable without links out of it whose undirected neighbours are
    neighbours of all its other neighbours takes all its open links in (Dor and Tarsi). Conflicting links count as undirected.

    If the graph stands for no class (conflicts can lead to that), the rest is directed in the given order."""
    n = len(graph)
    order = list(range(n)) if order is None else list(order)
    g, left = graph.copy(), set(range(n))
    open_ = lambda i, j: g[i, j, 0] in ("o-o", "x-x")
    near = lambda i: {j for j in left if j != i and g[i, j, 0] != ""}
    out = graph.copy()

    def point(i: int, j: int) -> None:
        out[i, j, 0], out[j, i, 0] = "-->", "<--"

    while left:
        for x in order:
            if x not in left or any(g[x, j, 0] == "-->" for j in left):
                continue
            own = near(x)
            free = {j for j in own if open_(x, j)}
            if all(own - {j} <= near(j) for j in free):
                for j in free:
                    point(j, x)
                left.discard(x)
                break
        else:
            rank = {x: k for k, x in enumerate(order)}
            for i, j in combinations(sorted(left, key=rank.get), 2):
                if open_(i, j):
                    point(i, j)
            break
    return out


@dataclass
class _Selection:
    """State of the parent selection of one variable at one alpha."""

    j: int
    alpha: float
    assumed: dict[Node, str]

    def __post_init__(self):
        self.order = [n for n in self.assumed]
        self.val_min = {n: np.inf for n in self.order}
        self.p_max: dict[Node, float] = {n: 0.0 for n in self.order}
        self.val_at: dict[Node, float] = {n: 1.0 for n in self.order}

    def questions(self, dim: int, most: int) -> dict[Node, list[Question]]:
        return {n: [Question((n,), ((self.j, 0),), z) for z in islice(combinations([x for x in self.order if x != n], dim), most)] for n in self.order if self.assumed[n] != "-->"}

    def decide(self, sets: dict[Node, list[Question]], ask) -> None:
        gone = set()
        for n, part in sets.items():
            for q in part:
                a = ask([q])[0]
                self.val_min[n] = min(self.val_min[n], abs(a.val))
                if a.p >= self.p_max[n]:
                    self.p_max[n], self.val_at[n] = a.p, a.val
                if not a.p <= self.alpha:
                    gone.add(n)
                    break
        self.order = sorted((n for n in self.order if n not in gone), key=lambda n: -self.val_min[n])


def windowed(df: DataFrame, time: str, step: int, length: int) -> DataFrame:
    """df's rows once for each sliding window that holds them, with `run`, the window's number."""
    last = df.agg(F.max(time)).first()[0]
    count = len(range(0, (last or 0) + 1 - length, step))
    if count <= 0:
        raise ValueError("the series is shorter than a window")
    low = F.greatest(F.lit(0), F.ceil((F.col(time) - length + 1) / step))
    high = F.least(F.lit(count - 1), F.floor(F.col(time) / step))
    return df.where(low <= high).withColumn("run", F.explode(F.sequence(low.cast("long"), high.cast("long"))))


def resampled(df: DataFrame, samples: int, block: int, seed: int = 0) -> DataFrame:
    """Block-bootstrap samples of df's rows (dataset, t): each dataset's rows are drawn in blocks of consecutive ones, with `run`, the sample's number."""
    rows = numbered(df)
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("size"))
    draws = sizes.select("dataset", "size", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("run")).select("dataset", "size", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block) - 1)).alias("b"))
    start = F.pmod(F.xxhash64(F.lit(seed), "run", "b", "dataset"), F.greatest(F.lit(1), F.col("size") - block))
    places = draws.withColumn("start", start).select("dataset", "run", "b", "size", F.posexplode(F.sequence(F.col("start"), F.col("start") + block - 1)).alias("k", "pos"))
    places = places.where(F.col("b") * block + F.col("k") < F.col("size"))
    return places.select("dataset", F.col("run").cast("long").alias("run"), "pos").join(rows, ["dataset", "pos"]).drop("pos")


