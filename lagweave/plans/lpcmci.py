"""Discovery with hidden common causes: a partial ancestral graph of a stationary series.

A link's three marks are those of its ends and a middle one. Ends: '-' (ancestor), '<' or '>' (no ancestor), 'o' (unknown), 'x' (contradictory).
Middle: '?' (nothing known), 'L' or 'R' (no subset of the smaller or larger node's ancestors separates the ends), '!' (both), '-' (surely a link),
'x' (contradictory). Earlier nodes are smaller, then lower variables.

The search alternates removals and orientations: ancestors that are known early make conditioning sets that keep autocorrelation out of the tests.
A phase asks the questions of one class of links (a lag) in slices that don't depend on one another's answers; removals wait for the class's end, which
makes the result independent of the order of variables. Rules give claims (a is or is no ancestor of b; a link goes or
stays); contradictory claims mark the link instead of orienting it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, product

import numpy as np

from lagweave.operators.ci import Question
from lagweave.operators.embedding import Node

from .graphs import reverse
from .pcmci import Discovery, Found

#: Questions of one link that are asked at a time.
SLICE = 16
EARLY = ("apr", "r8", "r2", "r1", "r9", "r10")
ALL = ("apr", "r8", "r2", "r1", "r0d", "r0c", "r3", "r4", "r9", "r10", "r0b", "r0a")


def matches(link: str, pattern: str) -> bool:
    """'*' is any mark, '+' a head or a circle."""
    if not link or not pattern:
        return link == pattern
    return all(p == "*" or p == m or (p == "+" and m in "<>o") for p, m in zip(pattern, link))


def smaller(a: Node, b: Node) -> bool:
    return (a[1], a[0]) < (b[1], b[0])


def shifted(nodes: Iterable[Node], by: int) -> set[Node]:
    return {(v, t + by) for v, t in nodes}


class Marks:
    """The links, and who is known to be (1) or not to be (-1) an ancestor of whom; 0: contradictory."""

    def __init__(self, n: int, tau_max: int):
        self.n, self.tau_max = n, tau_max
        self.links: dict[tuple[Node, int], str] = {}
        self.known: dict[tuple[Node, int], int] = {}

    def link(self, a: Node, b: Node) -> str:
        """Marks from a to b; '' if they are no neighbours."""
        if abs(a[1] - b[1]) > self.tau_max:
            return ""
        if smaller(b, a):
            return reverse(self.link(b, a))
        return self.links.get(((a[0], a[1] - b[1]), b[0]), "")

    def put(self, a: Node, b: Node, link: str) -> None:
        if smaller(b, a):
            a, b, link = b, a, reverse(link)
        self.links[(a[0], a[1] - b[1]), b[0]] = link

    def pairs(self) -> Iterator[tuple[Node, Node]]:
        """Ends of all links, the smaller first, the other at lag 0."""
        for (a, j), link in sorted(self.links.items()):
            if link:
                yield a, (j, 0)

    def around(self, b: Node, window: bool = True) -> list[Node]:
        """Neighbours; with window those at lags -tau_max to 0."""
        low, high = (-self.tau_max, 0) if window else (b[1] - self.tau_max, b[1] + self.tau_max)
        return [(v, t) for t in range(max(low, b[1] - self.tau_max), min(high, b[1] + self.tau_max) + 1) for v in range(self.n) if self.link((v, t), b)]

    def ancestry(self, a: Node, b: Node) -> int | None:
        """1: a is an ancestor of b, -1: it is none, 0: claims contradict, None: unknown."""
        if a[1] > b[1]:
            return -1
        return self.known.get(((a[0], a[1] - b[1]), b[0]))

    def ancestors(self, nodes: Iterable[Node]) -> set[Node]:
        return {(v, t + b) for j, b in nodes for ((v, t), k), s in self.known.items() if s == 1 and k == j and t + b >= -self.tau_max}

    def parents(self, nodes: Iterable[Node]) -> set[Node]:
        """Neighbours with a tail towards one of the nodes, within the window."""
        return {a for b in nodes for a in self.around(b) if a[1] <= b[1] and self.link(a, b)[0] == "-"}

    def triples(self) -> Iterator[tuple[Node, Node, Node]]:
        """All a - b - c within a window, the latest of them at lag 0."""
        for b in range(self.n):
            near = self.around((b, 0), window=False)
            for a, c in product(near, repeat=2):
                last = max(a[1], c[1], 0)
                if a != c and last - min(a[1], c[1], 0) <= self.tau_max:
                    yield (a[0], a[1] - last), (b, -last), (c[0], c[1] - last)

    def claim(self, no: set[tuple[Node, Node]], yes: set[tuple[Node, Node]]) -> bool:
        """Takes claims (a, b): a is no ancestor, or an ancestor, of b. Whether a circle became a head or a tail."""
        at_zero = lambda a, b: ((a[0], a[1] - b[1]), b[0])
        back = lambda s: (((s[1], 0)), s[0][0])
        no = {at_zero(a, b) for a, b in no if a[1] <= b[1]} | {at_zero(b, a) for a, b in yes if a[1] == b[1]}
        yes = {at_zero(a, b) for a, b in yes if a[1] <= b[1]}
        torn, false, true, changed = set(), set(), set(), False
        for s in no:
            if self.known.get(s) != 0:
                (torn if self.known.get(s) == 1 or s in yes else false).add(s)
        for s in yes:
            if self.known.get(s) != 0 and not (s[0][1] == 0 and self.known.get(back(s)) == 0):
                (torn if self.known.get(s) == -1 or s in no else true).add(s)
        for s in torn:
            a, b = s[0], (s[1], 0)
            if (link := self.link(a, b)) and link[0] != "x":
                self.put(a, b, "x" + link[1:])
            self.known[s] = 0
            if a[1] == 0 and self.known.get(back(s)) == 1:
                del self.known[back(s)]
        for s in false:
            a, b = s[0], (s[1], 0)
            if (link := self.link(a, b)) and link[0] != "<":
                self.put(a, b, "<" + link[1:])
                changed = True
            self.known[s] = -1
        for s in true:
            a, b = s[0], (s[1], 0)
            if (link := self.link(a, b)) and (link[0], link[2]) != ("-", ">"):
                self.put(a, b, f"-{link[1]}>")
                changed = True
            self.known[s] = 1
            if a[1] == 0:
                self.known[back(s)] = -1
        return changed


class LatentDiscovery(Discovery):
    """Search for a partial ancestral graph; questions, tests and batches as in Discovery."""

    def run_lpcmci(self, tau_max: int = 1, tau_min: int = 0, pc_alpha: float = 0.05, preliminary: int = 1, max_cond_px: int = 0, max_p: float = np.inf, max_p_non_ancestral: float = np.inf, max_q: float = np.inf, max_pds: float = np.inf, links: dict[int, dict[Node, str]] | None = None, colliders_early: bool = True, only_preliminary: bool = False, non_ancestral: bool = True, middle_marks: bool = True, parents_of_lagged: bool = True, remember_only_parents: bool = True, auto_first: bool = True) -> Found:
        if not 0 <= tau_min <= tau_max:
            raise ValueError("0 <= tau_min <= tau_max")
        self.at(tau_max)
        self.tau_max, self.tau_min, self.alpha, self.max_px = tau_max, tau_min, pc_alpha, max_cond_px
        self.max_p, self.max_p_na, self.max_q, self.max_pds = max_p, max_p_non_ancestral, max_q, max_pds
        self.by_direction, self.both_parents, self.auto_first, self.assumed = max_cond_px == 0 and middle_marks, parents_of_lagged, auto_first, links
        self.start()
        for k in range(preliminary):
            self.ancestral_phase(early=True, colliders=colliders_early)
            if only_preliminary and k == preliminary - 1:
                break
            learnt = {(a, (j, 0)) for (a, j), s in self.g.known.items() if s == 1 and (not remember_only_parents or self.g.link(a, (j, 0)))}
            self.start()
            self.g.claim(set(), learnt)
        if not only_preliminary:
            self.ancestral_phase(early=False, colliders=True)
            if non_ancestral:
                self.non_ancestral_phase()
        self.sure()
        self.orient(ALL)
        self.sure()
        return self.result()

    def start(self) -> None:
        """The complete graph, less what is assumed absent; nothing known."""
        self.g, self.sepsets, self.best = Marks(self.n, self.tau_max), {}, {}
        for i, j, t in product(range(self.n), range(self.n), range(self.tau_min, self.tau_max + 1)):
            if t or i < j:
                self.g.put((i, -t), (j, 0), "o?o" if not t else "oL>" if self.by_direction else "o?>")
        for j, own in (self.assumed or {}).items():
            for (i, lag), link in own.items():
                if lag > 0 or -lag > self.tau_max or (i, lag) == (j, 0) or (link and (len(link) != 3 or (lag and link[2] != ">"))):
                    raise ValueError(f"no such link: {(i, lag)} {link} {j}")
                if link and link[1] == "?" and lag and self.by_direction:
                    link = f"{link[0]}L{link[2]}"
                self.g.put((i, lag), (j, 0), link)
                if link and link[0] == "-":
                    self.g.known[(i, lag), j] = 1
                elif link and link[0] == "<":
                    self.g.known[(i, lag), j] = -1

    # -- tests -------------------------------------------------------------------------------------------

    def normal(self, a: Node, b: Node, z: Iterable[Node]) -> tuple[Node, Node, frozenset[Node]]:
        """The question with the larger node at lag 0, the conditions within the window."""
        if smaller(b, a):
            a, b = b, a
        z = shifted(z, -b[1])
        x, y = (a[0], a[1] - b[1]), (b[0], 0)
        return x, y, frozenset(n for n in z if -self.tau_max <= n[1] <= 0 and n not in (x, y))

    def tests(self, questions: list[tuple[Node, Node, frozenset[Node]]]) -> list[bool]:
        """Whether each is dependent; the largest p of each pair is kept, and its value."""
        out = []
        for (x, y, z), a in zip(questions, self.ask([Question((x,), (y,), tuple(sorted(z))) for x, y, z in questions])):
            if (x, y) not in self.best or a.p > self.best[x, y][0]:
                self.best[x, y] = a.p, a.val
            out.append(bool(a.p <= self.alpha))
        return out

    def apart(self, x: Node, y: Node, z: frozenset[Node], minimal: bool) -> None:
        """Keeps a separating set."""
        own = self.sepsets.setdefault((x, y), {})
        own[z] = own.get(z, False) or minimal

    def separating(self, a: Node, b: Node, minimal: bool = False) -> set[frozenset[Node]]:
        """Kept sets, in the times of a and b."""
        x, y, _ = self.normal(a, b, ())
        by = max(a[1], b[1])
        return {frozenset(shifted(z, by)) for z, least in self.sepsets.get((x, y), {}).items() if least or not minimal}

    def strongest_first(self, nodes: Iterable[Node], to: Node) -> list[Node]:
        """By the size of the weakest value found for the pair, unknown ones first."""
        size = lambda n: abs(self.best[self.normal(n, to, ())[:2]][1]) if self.normal(n, to, ())[:2] in self.best else np.inf
        return sorted(nodes, key=lambda n: (-size(n), n))

    def first_separating(self, jobs: list[tuple[Node, Node, Iterator[frozenset[Node]]]]) -> set[tuple[Node, Node]]:
        """Pairs that one of their sets separates; sets are asked for in slices, all pairs' at once."""
        gone = set()
        while jobs:
            asked = [(x, y, sets, [self.normal(x, y, z) for z in islice(sets, SLICE)]) for x, y, sets in jobs]
            jobs = []
            self.tests([q for *_, part in asked for q in part])
            for x, y, sets, part in asked:
                hit = next((q for q, dependent in zip(part, self.tests(part)) if not dependent), None)
                if hit:
                    gone.add((x, y))
                    self.apart(*hit, True)
                elif len(part) == SLICE:
                    jobs.append((x, y, sets))
        return gone

    # -- sets to condition on ---------------------------------------------------------------------------

    def parents_of(self, a: Node, b: Node) -> set[Node]:
        ends = (a, b) if self.both_parents or a[1] == b[1] else (a if smaller(b, a) else b,)
        return self.g.parents(ends) - {a, b}

    def possible_ancestors(self, a: Node, b: Node) -> set[Node]:
        """Neighbours of a, not later than it, that may be its ancestors."""
        return {n for n in self.g.around(a) if n[1] <= a[1] and n != b and self.g.link(n, a)[0] != "<"}

    def wide(self, a: Node, b: Node) -> set[Node]:
        """Neighbours of a that may be its ancestors, and nodes that paths of possible colliders reach from a; no descendants of b or known bystanders."""
        g = self.g
        near = {n for n in self.possible_ancestors(a, b) if g.ancestry(b, n) != 1}
        todo = [(n, a) for n in g.around(a) if n != b and n[1] <= b[1] and g.link(n, a)[0] != "-" and g.link(n, a)[2] != "-" and g.ancestry(n, b) != -1]
        seen = set(todo)
        while todo:
            now, before = todo.pop()
            for n in g.around(now):
                if n in (a, b, before) or (n, now) in seen:
                    continue
                left, right = g.link(n, now)[2], g.link(before, now)[2]
                if "-" in (left, right) or (not g.link(n, before) and "o" in (left, right)):
                    continue
                if g.ancestry(a, n) == 1 or g.ancestry(b, n) == 1 or (g.ancestry(n, a) == -1 and g.ancestry(n, b) == -1):
                    continue
                seen.add((n, now))
                todo.append((n, now))
        return (near | {n for n, _ in seen}) - {a, b}

    # -- phases --------------------------------------------------------------------------------------------

    def classes(self) -> list[list[tuple[Node, Node]]]:
        """Links in the order of their tests: own past, then lag by lag."""
        pairs = list(self.g.pairs())
        own = [(x, y) for x, y in pairs if self.auto_first and x[0] == y[0]]
        return [own] + [[(x, y) for x, y in pairs if -x[1] == t and (x, y) not in own] for t in range(self.tau_max + 1)]

    def middle(self, x: Node, y: Node, mark: str) -> None:
        link = self.g.link(x, y)
        now = link[1]
        if now not in ("?", "L", "R") or now == mark:
            return
        self.g.put(x, y, link[0] + (mark if now == "?" else "!") + link[2])

    def directions(self) -> None:
        """An end that is no ancestor of the other need not be separated by the other's ancestors alone: with a head at one end, only that end's ancestors are searched."""
        for x, y in list(self.g.pairs()):
            link = self.g.link(x, y)
            if link[2] == ">":
                self.middle(x, y, "L")
            if link[0] == "<":
                self.middle(x, y, "R")

    def subsets(self, search: list[Node], default: set[Node], p: int) -> Iterator[frozenset[Node]]:
        sets = combinations(search, p)
        return (frozenset(s) | default for s in (sets if np.isinf(self.max_q) else islice(sets, int(self.max_q))))

    def ancestral_phase(self, early: bool, colliders: bool) -> None:
        """Removes links that sets of possible ancestors of an end, with all known parents, separate."""
        p = 0
        while p <= self.max_p:
            done, removed = True, False
            for group in self.classes():
                jobs = []
                for x, y in group:
                    mark = self.g.link(x, y)[1]
                    if mark == "-":
                        continue
                    sides = []
                    if mark not in "R!":
                        sides.append((y, x, "R"))
                    if mark not in "L!" and (x[1] == 0 or 0 < self.max_px >= p):
                        sides.append((x, y, "L"))
                    sets = []
                    for a, b, name in sides:
                        default = self.parents_of(a, b)
                        search = self.possible_ancestors(a, b) - default
                        if len(search) < p:
                            self.middle(x, y, name)
                        else:
                            done = False
                            sets.append(self.subsets(self.strongest_first(search, a), default, p))
                    if sets:
                        jobs.append((x, y, (z for part in sets for z in part)))
                for x, y in self.first_separating(jobs):
                    self.g.put(x, y, "")
                    removed = True
            if removed and self.orient(EARLY, only_lagged=True):
                if self.by_direction:
                    self.directions()
                p = 0
            elif not removed and done:
                break
            else:
                p += 1
        for x, y in list(self.g.pairs()):
            link = self.g.link(x, y)
            if link[1] not in "-!":
                self.g.put(x, y, f"{link[0]}!{link[2]}")
        if self.orient(ALL if colliders else EARLY) and self.by_direction:
            self.directions()

    def non_ancestral_phase(self) -> None:
        """Removes links that sets of nodes on possible collider paths separate, beside known ancestors."""
        self.directions()
        p = 0
        while p <= min(self.max_p, self.max_p_na):
            done, removed = True, False
            for group in self.classes():
                jobs = []
                for x, y in group:
                    if self.g.link(x, y)[1] == "-":
                        continue
                    sets, enough = [], True
                    for a, b in [(y, x)] + ([(x, y)] if x[1] == 0 or 0 < self.max_px >= p else []):
                        pool = self.wide(a, b)
                        default = (pool & self.g.ancestors([a, b])) | self.parents_of(a, b)
                        search = pool - default
                        enough &= p <= len(search) <= self.max_pds
                        sets.append(self.subsets(self.strongest_first(search, a), default - {a, b}, p))
                    if enough:
                        done = False
                        jobs.append((x, y, (z for part in sets for z in part)))
                for x, y in self.first_separating(jobs):
                    self.g.put(x, y, "")
                    removed = True
            if removed and self.orient(ALL):
                self.directions()
                p = 0
            elif not removed and done:
                break
            else:
                p += 1
        self.sure()

    def sure(self) -> None:
        for x, y in list(self.g.pairs()):
            link = self.g.link(x, y)
            self.g.put(x, y, f"{link[0]}-{link[2]}")

    # -- orientation -----------------------------------------------------------------------------------------

    def orient(self, rules: Iterable[str], only_lagged: bool = False) -> bool:
        """Rules one after another, from the first again after each that told something new. Whether any did."""
        rules, k, ever = list(rules), 0, False
        while k < len(rules):
            self.no, self.yes, self.drop, self.keep = set(), set(), set(), set()
            self.votes: dict = {}
            getattr(self, rules[k])(only_lagged)
            torn = self.drop & self.keep
            for x, y in self.drop - torn:
                self.g.put(x, y, "")
            for pairs, mark in ((self.keep - torn, "-"), (torn, "x")):
                for x, y in pairs:
                    link = self.g.link(x, y)
                    self.g.put(x, y, link[0] + mark + link[2])
            told = self.g.claim(self.no, self.yes)
            told |= bool((self.drop ^ self.keep) - torn)
            for x, y in self.drop - torn:
                self.minimise(x, y)
            ever |= told
            k = 0 if told else k + 1
        return ever

    def minimise(self, x: Node, y: Node) -> None:
        """Replaces the sets found for a removed link by weakly minimal ones: no node that isn't a known ancestor can be left out."""
        known = self.g.ancestors([x, y])
        sets = list(self.sepsets.pop((x, y), {}))
        least = min(map(len, sets))
        todo = {z for z in sets if len(z) == least}
        while True:
            final = {z for z in todo if len(z) <= 1 or z <= known}
            if not final:
                smaller_sets: dict[frozenset[Node], float] = {}
                for z in todo:
                    less = [self.normal(x, y, z - {n}) for n in sorted(z - known)]
                    free = [q for q, dependent in zip(less, self.tests(less)) if not dependent]
                    if not free:
                        final.add(z)
                    for q, a in zip(free, self.ask([Question((a,), (b,), tuple(sorted(c))) for a, b, c in free])):
                        smaller_sets[q[2]] = a.val
            if final:
                for z in final:
                    self.apart(x, y, z, True)
                return
            most = max(smaller_sets.values())
            todo = {z for z, v in smaller_sets.items() if v == most}

    def vote(self, a: Node, b: Node, c: Node) -> int:
        """Whether b is in more (1) or fewer (-1) than half of the sets that separate a and c; 0: neither."""
        if smaller(c, a):
            a, c = c, a
        key = a, b, c
        if key not in self.votes:
            extra = self.parents_of(a, c)
            pools = [(sorted(self.possible_ancestors(a, c) - extra - {a, c}), min(self.max_p, self.max_px if a[1] < c[1] else np.inf)), (sorted(self.possible_ancestors(c, a) - extra - {a, c}), self.max_p)]
            asked = {}
            for pool, most in pools:
                for p in range(int(min(len(pool), most)) + 1):
                    sets = combinations(pool, p)
                    for z in sets if np.isinf(self.max_q) else islice(sets, int(self.max_q)):
                        asked[self.normal(a, c, extra | set(z))] = None
            found = {q[2] for q, dependent in zip(asked, self.tests(list(asked))) if not dependent}
            x, y, _ = self.normal(a, c, ())
            found |= set(self.sepsets.get((x, y), {}))
            within = sum((b[0], b[1] - c[1]) in z for z in found)
            self.votes[key] = (2 * within > len(found)) - (2 * within < len(found))
        return self.votes[key]

    def head(self, a: Node, b: Node) -> None:
        """Claims a head at b on the link from a."""
        self.no.add((b, a))

    def directed(self, a: Node, b: Node) -> None:
        self.yes.add((a, b))

    def pair(self, a: Node, b: Node) -> tuple[Node, Node]:
        return self.normal(a, b, ())[:2]

    def unshielded(self) -> Iterator[tuple[Node, Node, Node]]:
        return ((a, b, c) for a, b, c in self.g.triples() if not self.g.link(a, c))

    def apr(self, only_lagged: bool) -> None:
        """A directed link that no set of the later end's ancestors separates is a link."""
        for x, y in self.g.pairs():
            link = self.g.link(x, y)
            if matches(link, "-!>") or matches(link, "-R>") or matches(link, "<!-") or matches(link, "<L-"):
                self.keep.add((x, y))

    def r1(self, only_lagged: bool) -> None:
        for a, b, c in self.unshielded():
            if not (only_lagged and b[1] == c[1]) and matches(self.g.link(a, b), "**>") and matches(self.g.link(b, c), "o*+") and self.vote(a, b, c) == 1:
                self.directed(b, c)

    def r2(self, only_lagged: bool) -> None:
        for a, b, c in self.g.triples():
            if only_lagged and a[1] == c[1]:
                continue
            ab, bc = self.g.link(a, b), self.g.link(b, c)
            if matches(self.g.link(a, c), "+*o") and ((matches(ab, "-*>") and matches(bc, "**>")) or (matches(ab, "**>") and matches(bc, "-*>"))):
                self.head(a, c)

    def r3(self, only_lagged: bool) -> None:
        g = self.g
        for a, b, c in self.unshielded():
            if not (matches(g.link(a, b), "**>") and matches(g.link(c, b), "**>")):
                continue
            for d in g.around(b, window=False):
                span = [n[1] for n in (a, b, c, d)]
                if d in (a, c) or max(span) - min(span) > self.tau_max or (only_lagged and d[1] == b[1]):
                    continue
                if matches(g.link(a, d), "+*o") and matches(g.link(b, d), "o*+") and matches(g.link(c, d), "+*o") and self.vote(a, d, c) == 1:
                    self.head(d, b)

    def r4(self, only_lagged: bool) -> None:
        """Paths x1 ... w, v, y on which all nodes between x1 and v are colliders and parents of y, x1 and y no neighbours."""
        g = self.g
        for w, v, y in g.triples():
            if (only_lagged and w[1] == v[1] == y[1]) or not (matches(g.link(w, v), "<-*") and matches(g.link(v, y), "o-+") and matches(g.link(w, y), "-->")):
                continue
            todo, ends = [[y, v, w]], set()
            while todo:
                path = todo.pop()
                last = path[-1]
                if len(path) > 3 and not g.link(last, y):
                    ends.add(last)
                elif g.link(last, path[-2])[0] == "<" and g.link(last, y) == "-->":
                    todo += [[*path, n] for n in g.around(last) if n not in path and matches(g.link(n, last), "*->")]
            for x1 in ends:
                vote = self.vote(x1, v, y)
                if vote == 1:
                    self.directed(v, y)
                elif vote == -1 and g.link(w, v) != "<-x":
                    self.head(v, y)
                    self.head(y, v)
                    self.head(w, v)

    def r8(self, only_lagged: bool) -> None:
        for a, b, c in self.g.triples():
            if not (only_lagged and a[1] == c[1]) and matches(self.g.link(a, b), "-*>") and matches(self.g.link(b, c), "-*>") and matches(self.g.link(a, c), "o*+"):
                self.directed(a, c)

    def open_paths(self, start: Node, end: Node, allowed: tuple[str, ...]) -> Iterator[list[Node]]:
        """Paths of three nodes or more that may be directed and on which no node's neighbours are neighbours."""
        todo = [([start], allowed)]
        while todo:
            path, patterns = todo.pop()
            if path[-1] == end:
                if len(path) > 2:
                    yield path
                continue
            for n in self.g.around(path[-1]):
                link = self.g.link(path[-1], n)
                if n in path or (len(path) > 1 and self.g.link(path[-2], n)) or not any(matches(link, p) for p in patterns):
                    continue
                todo.append(([*path, n], ("o*o", "o*>", "-*>") if matches(link, "o*o") else ("-*>",)))

    def chained(self, path: list[Node]) -> bool:
        """Each inner node is in its neighbours' separating sets, up to the first link that is into its later node."""
        for a, b, c in zip(path, path[1:], path[2:]):
            if self.g.link(a, b)[2] == ">":
                return True
            if self.vote(a, b, c) != 1:
                return False
        return True

    def r9(self, only_lagged: bool) -> None:
        g = self.g
        for b, a, c in self.unshielded():
            first = g.link(a, b)
            if (only_lagged and a[1] == c[1]) or not matches(g.link(a, c), "o*>") or not any(matches(first, p) for p in ("o*o", "o*>", "-*>")):
                continue
            if self.vote(b, a, c) != 1:
                continue
            for path in self.open_paths(b, c, ("-*>", "o*>", "o*o") if matches(first, "o*o") else ("-*>",)):
                if len(path) >= 3 and a not in path and not g.link(a, path[1]) and (first[2] == ">" or (self.vote(a, b, path[1]) == 1 and self.chained(path))):
                    self.directed(a, c)
                    break

    def r10(self, only_lagged: bool) -> None:
        g = self.g
        into: dict[tuple[Node, Node], set[Node]] = {}
        for a, c, d in g.triples():
            if not (only_lagged and a[1] == c[1]) and matches(g.link(a, c), "o*>") and matches(g.link(c, d), "<*-"):
                into.setdefault((a, c), set()).add(d)
        for (a, c), ends in into.items():
            second = set()
            for d in sorted(ends):
                for path in self.open_paths(a, d, ("-*>", "o*>", "o*o")):
                    if c not in path and not g.link(path[-2], c) and self.chained([*path, c]):
                        second.add(path[1])
            if any(not g.link(m, n) and self.vote(m, a, n) == 1 for m, n in combinations(sorted(second), 2)):
                self.directed(a, c)

    def still_separated(self, a: Node, b: Node, c: Node) -> bool:
        """Whether a minimal set of a and c, with the known parents, separates a and b; those sets are kept, and the link goes."""
        if self.g.link(a, b)[1] in "-x":
            return False
        extra = self.parents_of(a, b)
        asked = [self.normal(a, b, z | extra) for z in self.separating(a, c, minimal=True)]
        hits = [q for q, dependent in zip(asked, self.tests(asked)) if not dependent]
        for q in hits:
            self.apart(*q, False)
        if hits:
            self.drop.add(self.pair(a, b))
        return bool(hits)

    def r0a(self, only_lagged: bool) -> None:
        g = self.g
        for a, b, c in self.unshielded():
            if (only_lagged and (a[1] == b[1] or b[1] == c[1])) or smaller(c, a):
                continue
            ab, cb = g.link(a, b), g.link(c, b)
            gone = [self.still_separated(a, b, c), self.still_separated(c, b, a)]
            if any(gone) or ab[2] in "-x" or cb[2] in "-x" or "x" in (ab[1], cb[1]) or ab[2] == cb[2] == ">":
                continue
            if self.vote(a, b, c) == -1:
                self.head(a, b)
                self.head(c, b)

    def unsure(self, b: Node, c: Node) -> bool:
        """A circle at b on a link to c that no set of b's side separates."""
        link = self.g.link(b, c)
        return matches(link, "o!+") or (matches(link, "oR+") and smaller(b, c)) or (matches(link, "oL+") and smaller(c, b))

    def r0b(self, only_lagged: bool) -> None:
        for a, b, c in self.unshielded():
            if (only_lagged and a[1] == b[1]) or not matches(self.g.link(a, b), "**>") or not self.unsure(b, c):
                continue
            if self.still_separated(a, b, c) or self.g.link(a, b)[1] == "x" or (only_lagged and b[1] == c[1]):
                continue
            if self.vote(a, b, c) == -1:
                self.head(c, b)

    def r0c(self, only_lagged: bool) -> None:
        for a, b, c in self.unshielded():
            if not (only_lagged and b[1] == c[1]) and matches(self.g.link(a, b), "*-*") and self.unsure(b, c) and self.vote(a, b, c) == -1:
                self.head(c, b)

    def r0d(self, only_lagged: bool) -> None:
        for a, b, c in self.unshielded():
            ab = self.g.link(a, b)
            if not (only_lagged and a[1] == b[1] and b[1] == c[1]) and (matches(ab, "*-o") or matches(ab, "*->")) and matches(self.g.link(b, c), "o-*") and self.vote(a, b, c) == -1:
                self.head(a, b)
                self.head(c, b)

    def result(self) -> Found:
        shape = (self.n, self.n, self.tau_max + 1)
        graph, val, p = np.full(shape, "", dtype="<U3"), np.zeros(shape), np.zeros(shape)
        for (i, lag), (j, _) in self.g.pairs():
            link = self.g.link((i, lag), (j, 0))
            graph[i, j, -lag] = link
            if lag == 0:
                graph[j, i, 0] = reverse(link)
        for ((i, lag), (j, _)), (most, value) in self.best.items():
            val[i, j, -lag], p[i, j, -lag] = value, most
            if lag == 0:
                val[j, i, 0], p[j, i, 0] = value, most
        return Found(val, p, graph, sepsets={k: list(v) for k, v in self.sepsets.items()})
