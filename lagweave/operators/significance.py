"""Other ways to a p value and to an interval than a test's own: block shuffling, a fixed threshold, block bootstrap.

Each wraps a test and is a test itself, so that searches over graphs take it in the test's place. A wrapped test states
how it comes to its value on arrays: reduced(x, y, z, generator) gives what is compared (residuals on Z, say)
and between(a, b) the value. Tests of other forms say so by value(x, y, z, generator).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from lagweave.functions.transforms import block_length

from .ci import Answer, Data, ParCorr, Question, SampleTest, arrays


def series_block(x: np.ndarray, most: float = 0.1) -> int:
    """Block length for a series from its autocorrelation up to a tenth of it."""
    n = len(x)
    top = max(5, n // 10)
    x = x - x.mean()
    if n < 8 or not x.any():
        return 1
    r = np.array([1.0] + [float(np.corrcoef(x[:-k], x[k:])[0, 1]) if x[:-k].std() and x[k:].std() else 0.0 for k in range(1, min(top, n - 2) + 1)])
    return block_length(r, n, most)


def shuffled_blocks(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Row numbers of a series whose blocks of consecutive rows change places; one block, at any place, may be shorter."""
    starts = rng.permutation(np.arange(0, n, block))
    return np.concatenate([np.arange(a, min(a + block, n)) for a in starts])


def drawn_blocks(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Row numbers of a block-bootstrap sample of n rows."""
    starts = rng.integers(0, max(1, n - block + 1), -(-n // block))
    return (starts[:, None] + np.arange(block)).ravel()[:n]


def value_of(test, x, y, z, rng) -> float:
    if hasattr(test, "between"):
        return test.between(*test.reduced(x, y, z, rng))
    return float(test.value(x, y, z, rng))


class Shuffled(SampleTest):
    """A test's value with p from shuffling X's part in blocks: the share of samples with a value as large, in size for two-sided tests."""

    def __init__(self, inner=None, samples: int = 500, block: int | None = None):
        self.inner, self.samples, self.block = inner or ParCorr(), samples, block
        self.name, self.two_sided = f"shuffled_{self.inner.name}", self.inner.two_sided

    def measure(self, x, y, z, rng):
        if hasattr(self.inner, "between"):
            a, b = self.inner.reduced(x, y, z, rng)
            again = lambda at: self.inner.between(a[at], b)
            val = self.inner.between(a, b)
        else:
            a = x
            again = lambda at: self.inner.value(x[at], y, z, rng)
            val = self.inner.value(x, y, z, rng)
        block = self.block or series_block(a if a.ndim == 1 else a[:, 0])
        null = np.array([again(shuffled_blocks(len(x), block, rng)) for _ in range(self.samples)])
        return val, float((np.abs(null) >= abs(val)).mean() if self.two_sided else (null >= val).mean())


class Thresholded:
    """A test's value, dependent where it reaches a threshold: p is 0 there, else 1."""

    def __init__(self, inner, threshold: float):
        self.inner, self.threshold, self.name, self.two_sided = inner, threshold, inner.name, inner.two_sided

    def run(self, data: Data, questions: Sequence[Question]) -> list[Answer]:
        size = abs if self.two_sided else float
        return [Answer(a.val, 0.0 if size(a.val) >= self.threshold else 1.0, a.n, a.dim, a.conf) for a in self.inner.run(data, questions)]


class Bootstrapped(SampleTest):
    """A test with a percentile interval of its value from block-bootstrap samples of the rows; p is the test's own."""

    def __init__(self, inner=None, level: float = 0.9, samples: int = 100, block: int | None = None):
        self.inner, self.level, self.samples, self.block = inner or ParCorr(), level, samples, block
        self.name, self.two_sided = self.inner.name, self.inner.two_sided

    def measure(self, x, y, z, rng):
        if isinstance(self.inner, SampleTest):
            val, p = self.inner.measure(x, y, z, rng)[:2]
        else:
            val = value_of(self.inner, x, y, z, rng)
            p = self.inner.p_value(val, len(x), x.shape[1] + y.shape[1] + z.shape[1])
        block = self.block or max(series_block(v[:, 0]) for v in (x, y))
        values = []
        for _ in range(self.samples):
            at = drawn_blocks(len(x), block, rng)
            values.append(value_of(self.inner, x[at], y[at], z[at], rng))
        low, high = np.quantile(values, [(1 - self.level) / 2, (1 + self.level) / 2])
        return val, p, low, high


class AugmentedPairwise(SampleTest):
    """Vectors by their pairs of components, with conditions learnt beforehand: on the first share of the rows pairs that look independent are found; on the rest each pair is
    also given the components of X (or of Y, if those are as many) that looked independent of its other member. Largest statistic, smallest p times the number of pairs."""

    name, two_sided = "pairwise_augmented", True

    def __init__(self, inner=None, alpha: float = 0.5, share: float = 0.2):
        self.inner, self.alpha, self.share = inner or ParCorr(), alpha, share

    def _one(self, x, y, z) -> tuple[float, float]:
        return run_test_raw(self.inner, x, y, z)[:2]

    def measure(self, x, y, z, rng):
        first = int(self.share * len(x))
        first = first if first >= 10 else 0
        apart = np.zeros((x.shape[1], y.shape[1]), bool)
        if first:
            apart = np.array([[self._one(x[:first, j], y[:first, k], z[:first])[1] > self.alpha for k in range(y.shape[1])] for j in range(x.shape[1])])
        best, least = 0.0, 1.0
        for j in range(x.shape[1]):
            for k in range(y.shape[1]):
                more_y = [m for m in np.flatnonzero(apart[j]) if m != k]
                more_x = [m for m in np.flatnonzero(apart[:, k]) if m != j]
                extra = x[first:, more_x] if len(more_x) > len(more_y) else y[first:, more_y]
                val, p = self._one(x[first:, j], y[first:, k], np.concatenate([z[first:], extra], axis=1))
                least = min(least, p)
                best = val if abs(val) > abs(best) else best
        return best, min(1.0, least * apart.size)


def run_test(test, data: Data, x, y, z=(), alpha: float | None = None) -> tuple[float, float, bool | None]:
    """(value, p, dependent at alpha) of one question about nodes."""
    a = test.run(data, [Question(tuple(x), tuple(y), tuple(z))])[0]
    return a.val, a.p, None if alpha is None else bool(a.p <= alpha)


def run_test_raw(test, x, y, z=None, alpha: float | None = None, seed: int = 42, **more) -> tuple[float, float, bool | None]:
    """The same on arrays (rows, variables)."""
    if isinstance(test, SampleTest):
        a = test.raw(x, y, z, seed, **more)
    else:
        x, y, z = arrays(x, y, z)
        val = value_of(test, x, y, z, np.random.default_rng([seed, 0]))
        a = Answer(val, test.p_value(val, len(x), x.shape[1] + y.shape[1] + z.shape[1]))
    return a.val, a.p, None if alpha is None else bool(a.p <= alpha)


def measure_raw(test, x, y, z=None, seed: int = 42) -> float:
    """The value alone."""
    return value_of(test, *arrays(x, y, z), np.random.default_rng([seed, 0]))
