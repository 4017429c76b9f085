"""Preprocessing of series: smoothing, binning, ranks, symbols, autocorrelation, filters.

Functions take a DataFrame (dataset, t, value columns) or a Panel's df and stay in DataFrame operations; recursive
filters, which have no relational form, run in an Arrow function. No window spans a whole series: it is cut into blocks of times
that overlap, or into parts of the range of values.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Times in a block of a long series.
BLOCK = 1 << 16


def overlapping(df: DataFrame, before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """df's rows by `block` of times, each block with the last `before` rows of the one before it and the first `after` of the next: one long series is work for many tasks."""
    block = max(block, before + 1, after + 1)
    own, place = F.floor(F.col("t") / block), F.pmod(F.col("t"), F.lit(block))
    at = F.array_compact(F.array(F.when(place < after, own - 1), own, F.when(place >= block - before, own + 1)))
    return df.withColumn("own", own).withColumn("block", F.explode(at)).withColumn("own", F.col("own") == F.col("block"))


def autocorrelation(df: DataFrame, value: str, max_lag: int) -> DataFrame:
    """(dataset, lag, r): Pearson's correlation of the series with itself, lag by lag; sums of blocks, so that neither lags nor length make a wide plan."""
    means = df.groupBy("dataset").agg(F.avg(value).alias("mean"))
    rows = overlapping(df.select("dataset", "t", F.col(value).cast("double").alias("x")), max_lag).join(means, "dataset").select("dataset", "block", "t", "own", (F.col("x") - F.col("mean")).alias("x"))

    def sums(t: pa.Table) -> pa.Table:
        at = t.column("t").to_numpy()
        first = int(at.min())
        x, own = np.full(int(at.max()) - first + 1, np.nan), np.zeros(int(at.max()) - first + 1, bool)
        x[at - first] = t.column("x").to_numpy(zero_copy_only=False)
        own[at - first] = t.column("own").to_numpy(zero_copy_only=False)
        out = []
        for k in range(max_lag + 1):
            a, b = x[k:], x[: len(x) - k]
            ok = own[k:] & ~np.isnan(a) & ~np.isnan(b)
            a, b = a[ok], b[ok]
            out.append((k, len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b))
        cols = [np.array(c) for c in zip(*out)]
        return pa.table({"dataset": pa.repeat(t.column("dataset")[0], len(out)), "lag": cols[0].astype(np.int32)} | {c: v.astype(float) for c, v in zip(("n", "a", "b", "aa", "bb", "ab"), cols[1:])})

    parts = rows.groupBy("dataset", "block").applyInArrow(sums, "dataset string, lag int, n double, a double, b double, aa double, bb double, ab double")
    total = parts.groupBy("dataset", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    r = (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt((F.col("n") * F.col("aa") - F.col("a") ** 2) * (F.col("n") * F.col("bb") - F.col("b") ** 2))
    return total.select("dataset", "lag", F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(r).alias("r"))


def block_length(r: np.ndarray, n: int, most: float = 0.1) -> int:
    """Block length for resampling from an autocorrelation: exponential decay of its envelope, then Pfeifer's formula; at most a share of the series, and a twentieth of it where the fit fails."""
    spectrum = np.fft.fft(r)
    half = np.zeros(len(r))
    half[0] = 1
    half[1 : (len(r) + 1) // 2] = 2
    if len(r) % 2 == 0:
        half[len(r) // 2] = 1
    envelope = np.abs(np.fft.ifft(spectrum * half))
    k = np.arange(len(r))
    a, d = 1.0, 0.9
    for _ in range(200):  # Gauss-Newton on a * d**k
        model = a * d**k
        j = np.stack([d**k, a * k * d ** np.maximum(k - 1, 0)], axis=1)
        if not np.isfinite(j).all():
            return max(1, int(0.05 * n))
        step = np.linalg.lstsq(j, envelope - model, rcond=None)[0]
        a, d = a + step[0], min(max(d + step[1], 1e-6), 1 - 1e-6)
        if np.abs(step).max() < 1e-10:
            break
    else:
        return max(1, int(0.05 * n))
    x = d / (1 - d)
    size = (4 * n * (x + x * x) ** 2 / (1 + 2 * x) ** 2) ** (1 / 3)
    return int(min(max(1, size), max(1, int(most * n))))


def smooth(df: DataFrame, value: str, width: int, kernel: str = "heaviside", residuals: bool = False, mask: str | None = None) -> DataFrame:
    """df with `smoothed`: the moving mean of 2 * ceil(width / 2) - 1 values, or the mean weighted by exp(-distance**2 / width**2); masked values carry no weight."""
    x = F.when(~F.col(mask), F.col(value)) if mask else F.col(value)
    if kernel == "heaviside":
        c = math.ceil(width / 2) - 1
        near = Window.partitionBy("dataset", "block").orderBy("t").rowsBetween(-c, c)
        out = overlapping(df, c, c).withColumn("smoothed", F.avg(x).over(near)).where("own").drop("own", "block")
    elif kernel == "gaussian":
        # beyond nine widths the weight is below 1e-35; where nothing is that near, weights relative to the nearest value count
        reach = 9 * width
        values = df.select("dataset", F.col("t").alias("s"), x.alias("v")).where("v is not null")
        near = values.select("dataset", "s", "v", F.explode(F.sequence(F.floor(F.col("s") / reach) - 1, F.floor(F.col("s") / reach) + 1)).alias("cell"))
        own = df.select("dataset", "t", F.floor(F.col("t") / reach).alias("cell"))
        pairs = own.join(near, ["dataset", "cell"]).where(F.abs(F.col("t") - F.col("s")) <= reach)
        weight = F.exp(-((F.col("t") - F.col("s")) ** 2) / F.lit(float(width**2)))
        means = pairs.groupBy("dataset", "t").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("smoothed"))
        far = df.select("dataset", "t").join(means, ["dataset", "t"], "left_anti")
        sides = []
        for pick, side in ((F.max_by, F.col("s") < F.col("t")), (F.min_by, F.col("s") > F.col("t"))):
            # cells of the occupied stretches, not values, are compared
            cells = values.groupBy("dataset", F.floor(F.col("s") / reach).alias("cell")).agg(F.min("s").alias("low"), F.max("s").alias("high"))
            edge = "high" if pick is F.max_by else "low"
            met = far.join(cells.withColumn("s", F.col(edge)), "dataset").where(side)
            sides.append(met.groupBy("dataset", "t").agg((F.max("s") if pick is F.max_by else F.min("s")).alias("s")))
        ends = sides[0].unionAll(sides[1])
        least = ends.groupBy("dataset", "t").agg(F.min(F.abs(F.col("t") - F.col("s"))).alias("least"))
        spots = ends.join(least, ["dataset", "t"]).select("dataset", "t", "least", F.explode(F.sequence(F.floor(F.col("s") / reach) - 1, F.floor(F.col("s") / reach) + 1)).alias("cell")).distinct()
        whole = values.withColumn("cell", F.floor(F.col("s") / reach))
        rest = F.exp((F.col("least") ** 2 - (F.col("t") - F.col("s")) ** 2) / F.lit(float(width**2)))
        means = means.unionAll(spots.join(whole, ["dataset", "cell"]).groupBy("dataset", "t").agg((F.sum(rest * F.col("v")) / F.sum(rest)).alias("smoothed")))
        out = df.join(means, ["dataset", "t"], "left")
    else:
        raise ValueError("kernel is heaviside or gaussian")
    return out.withColumn("smoothed", F.col(value) - F.col("smoothed")) if residuals else out


def weighted_mean_std(value: str, weight: str) -> tuple[Column, Column]:
    """Aggregates: weighted mean and population deviation."""
    w = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    mean = F.sum(F.col(value) * F.col(weight)) / w
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(weight) * F.col(value) ** 2) / w - mean * mean))


def time_bins(df: DataFrame, values: list[str], length: int, mask: str | None = None) -> DataFrame:
    """Means of consecutive bins of `length` times; an incomplete last bin is left out, masked values too."""
    whole = df.groupBy("dataset").agg(F.floor((F.max("t") + 1) / length).alias("bins"))
    x = lambda c: F.when(~F.col(mask), F.col(c)) if mask else F.col(c)
    binned = df.withColumn("bin", F.floor(F.col("t") / length)).groupBy("dataset", "bin").agg(*[F.avg(x(c)).alias(c) for c in values])
    return binned.join(F.broadcast(whole), "dataset").where("bin < bins").select("dataset", F.col("bin").alias("t"), *values)


def placed(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """df with `rank` (values below, or equal and earlier), `upto` (values not above) and `many` (values) within the dataset; all NULL where the value is.

    Approximate quantiles cut a dataset's values into parts; counts of the parts give each its offset, and rows are sorted within a part only: one long series is work for many tasks."""
    x = F.col(value)
    cuts = df.where(x.isNotNull()).groupBy("dataset").agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 100 * parts).alias("cuts"))
    rows = df.join(cuts, "dataset", "left").withColumn("part", F.when(x.isNotNull(), F.size(F.filter("cuts", lambda c: c < x)))).drop("cuts")
    sizes = rows.where(x.isNotNull()).groupBy(F.col("dataset").alias("of"), F.col("part").alias("part_")).agg(F.count(F.lit(1)).alias("size"))
    upto = Window.partitionBy("of").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = sizes.select("of", "part_", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("of")).alias("many"))
    rows = rows.join(offsets, (F.col("dataset") == F.col("of")) & (F.col("part") == F.col("part_")), "left").drop("of", "part_")
    own = Window.partitionBy("dataset", "part")
    rank = F.row_number().over(own.orderBy(value, "t")) - 1 + F.col("before")
    level = F.count(F.lit(1)).over(own.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)) + F.col("before")
    return rows.withColumns({"rank": F.when(x.isNotNull(), rank), "upto": F.when(x.isNotNull(), level)}).drop("part", "before")


def uniform(df: DataFrame, value: str, out: str = "uniform") -> DataFrame:
    """df with the rank of a value over the number of values (ties: the largest)."""
    return placed(df, value).withColumn(out, F.col("upto") / F.col("many")).select(*df.columns, out)


def normal_quantile(u: Column) -> Column:
    """Standard normal quantile of u in (0, 1): Acklam's rational approximation, relative error below 1.2e-9."""
    # Fixed values of the approximation.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)

    def poly(q: Column, k) -> Column:
        out = F.lit(k[0])
        for x in k[1:]:
            out = out * q + F.lit(x)
        return out

    middle, tail = u - 0.5, F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    centre = poly(middle * middle, a) * middle / (poly(middle * middle, b) * (middle * middle) + 1)
    edge = poly(tail, c) / (poly(tail, d) * tail + 1)
    return F.when(F.least(u, 1 - u) >= 0.02425, centre).otherwise(F.when(u < 0.5, edge).otherwise(-edge))


def normal_scores(df: DataFrame, value: str, edge: float = 0.001, out: str = "score") -> DataFrame:
    """df with the normal quantile of the uniform rank; the largest value takes 1 - edge."""
    u = F.col("upto") / F.col("many")
    return placed(df, value).withColumn(out, normal_quantile(F.when(u >= 1, 1 - edge).otherwise(u))).select(*df.columns, out)


def ranks(df: DataFrame, value: str, out: str = "ranked") -> DataFrame:
    """df with the position in sorted order, from 0; ties in order of time."""
    return placed(df, value).withColumn(out, F.col("rank")).select(*df.columns, out)


def standardised(df: DataFrame, value: str, out: str = "standardised") -> DataFrame:
    """df with the value centred, over the population deviation of its dataset."""
    sums = df.groupBy(F.col("dataset").alias("of")).agg(F.avg(value).alias("mean_"), F.stddev_pop(value).alias("std_"))
    return df.join(sums, F.col("dataset") == F.col("of")).withColumn(out, (F.col(value) - F.col("mean_")) / F.col("std_")).select(*df.columns, out)


def scaled(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """df with the value between 0 and 1, within its dataset."""
    ends = df.groupBy(F.col("dataset").alias("of")).agg(F.min(value).alias("low_"), F.max(value).alias("high_"))
    return df.join(ends, F.col("dataset") == F.col("of")).withColumn(out, (F.col(value) - F.col("low_")) / (F.col("high_") - F.col("low_"))).select(*df.columns, out)


def ordinal_patterns(df: DataFrame, value: str, dim: int = 2, step: int = 1, noise_seed: int | None = None, mask: str | None = None, weights: bool = False) -> DataFrame:
    """df with `pattern`, the code of the order of `dim` values `step` apart that begin at t; rows without all of them are left out.

    Ties count as falling; with noise_seed values first get uniform noise of a millionth of their deviation. With mask, patterns that hold a masked value are left out;
    with weights, `weight` is the variance of the pattern's values."""
    if not 2 <= dim <= 10:
        raise ValueError("dim is 2 to 10")
    names = df.columns
    if noise_seed is not None:
        std = df.groupBy(F.col("dataset").alias("of")).agg(F.stddev_pop(value).alias("std_"))
        noise = F.pmod(F.xxhash64(F.lit(noise_seed), "dataset", "t"), F.lit(1 << 30)) / (1 << 30)
        df = df.join(std, F.col("dataset") == F.col("of")).withColumn("raised", F.col(value) + 1e-6 * F.col("std_") * noise)
    else:
        df = df.withColumn("raised", F.col(value))
    reach = (dim - 1) * step
    rows = overlapping(df, 0, reach)
    own = Window.partitionBy("dataset", "block").orderBy("t")
    ahead = [F.lead("raised", k * step).over(own) for k in range(dim)]
    code = F.when(ahead[0] < ahead[1], 1).otherwise(0)
    for i in range(2, dim):
        for j in range(i):
            code = code + F.when(ahead[j] < ahead[i], math.factorial(i)).otherwise(0)
    whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in ahead])
    if mask:
        whole = whole & reduce(lambda a, b: a & b, [~F.coalesce(F.lead(mask, k * step).over(own), F.lit(True)) for k in range(dim)])
    rows = rows.withColumn("pattern", code.cast("int")).withColumn("whole", whole)
    if weights:
        mean = reduce(lambda a, b: a + b, ahead) / dim
        rows = rows.withColumn("weight", reduce(lambda a, b: a + b, [(x - mean) * (x - mean) for x in ahead]) / dim)
    return rows.where(F.col("own") & F.col("whole")).select(*names, "pattern", *(["weight"] if weights else []))


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """df with `symbol`: how many lower edges are not above the value, less one; edges are every ceil(n / bins)-th sorted value."""
    symbol = F.floor((F.col("upto") - 1) / F.ceil(F.col("many") / bins))
    return placed(df, value).withColumn("symbol", symbol.cast("int")).select(*df.columns, "symbol")


def one_hot(df: DataFrame, value: str, categories: list) -> DataFrame:
    """df with a 0/1 column for each category."""
    return df.withColumns({f"{value}_{k}": F.when(F.col(value) == c, 1.0).otherwise(0.0) for k, c in enumerate(categories)})


def demeaned(df: DataFrame, value: str, by: list[str], out: str = "demeaned") -> DataFrame:
    """df with the value less the mean of its group: what dummies of the group would take up in a regression."""
    means = df.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(F.avg(value).alias("mean_"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_") for c in by])
    return df.join(means, same).withColumn(out, F.col(value) - F.col("mean_")).select(*df.columns, out)


def butterworth(cut: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a third-order Butterworth filter; cut is a share of the Nyquist frequency."""
    warped = 4 * math.tan(math.pi * cut / 2)
    poles = np.exp(1j * math.pi * (2 * np.arange(1, 4) + 2) / 6)
    poles = (warped / poles) if high else warped * poles
    z = (4 + poles) / (4 - poles)
    a = np.poly(z).real
    b = np.poly([1.0] * 3 if high else [-1.0] * 3)
    at = -1.0 if high else 1.0
    return b * np.polyval(a, at) / np.polyval(b, at), a


class Recursion:
    """A recursive filter, a chunk of values at a time: within a chunk it is a matrix, between chunks a state is handed on."""

    CHUNK = 64

    def __init__(self, b: np.ndarray, a: np.ndarray):
        self.b, self.a, n = b, a, len(a) - 1
        companion = np.eye(n) - np.column_stack([-a[1:], np.eye(n, n - 1)])
        self.steady = np.linalg.solve(companion, b[1:] - a[1:] * b[0])  # the state that a constant of 1 leaves as it is
        size = self.CHUNK
        self.of_values, self.to_state = np.zeros((size, size)), np.zeros((n, size))
        self.of_state, self.state_on = np.zeros((size, n)), np.zeros((n, n))
        for k in range(size):
            v = np.zeros(size)
            v[k] = 1
            self.of_values[:, k], self.to_state[:, k] = self.slow(v, np.zeros(n))
        for k in range(n):
            self.of_state[:, k], self.state_on[:, k] = self.slow(np.zeros(size), np.eye(n)[k])

    def slow(self, v: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(len(v))
        for k, x in enumerate(v):
            out[k] = self.b[0] * x + state[0]
            state = np.append(state[1:], 0) + self.b[1:] * x - self.a[1:] * out[k]
        return out, state

    def run(self, v: np.ndarray) -> np.ndarray:
        """From the steady state of the first value."""
        state, out, whole = self.steady * v[0], np.empty(len(v)), len(v) // self.CHUNK * self.CHUNK
        inner = v[:whole].reshape(-1, self.CHUNK)
        direct, pushed = inner @ self.of_values.T, inner @ self.to_state.T
        for k in range(len(inner)):
            out[k * self.CHUNK : (k + 1) * self.CHUNK] = direct[k] + self.of_state @ state
            state = self.state_on @ state + pushed[k]
        out[whole:] = self.slow(v[whole:], state)[0]
        return out

    def memory(self) -> int:
        """After so many values nothing is left of a state, to the last digit."""
        return int(np.ceil(40 / -np.log(np.abs(np.roots(self.a)).max())))


def filtered_both_ways(x: np.ndarray, b: np.ndarray, a: np.ndarray, at_start: bool = True, at_end: bool = True) -> np.ndarray:
    """Zero-phase filtering with odd extension at the ends (where they are the series') and steady initial states."""
    once = Recursion(b, a).run
    pad = min(3 * len(a), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1] if at_start else x[:0], x, 2 * x[-1] - x[-2 : -pad - 2 : -1] if at_end else x[:0]])
    first = pad if at_start else 0
    return once(once(ext)[::-1])[::-1][first : first + len(x)]


def pass_filter(df: DataFrame, value: str, period: float, kind: str = "low") -> DataFrame:
    """(dataset, t, filtered): slow ("low") or fast ("high") variation relative to a period. Blocks of times are filtered with so much of their neighbours that no trace of where they begin is left."""
    if kind not in ("low", "high"):
        raise ValueError("kind is low or high")
    b, a = butterworth(2 / period, kind == "high")
    reach = Recursion(b, a).memory()
    ends = df.groupBy(F.col("dataset").alias("of")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    rows = overlapping(df.select("dataset", "t", F.col(value).cast("double").alias("x")), reach, reach)
    rows = rows.join(ends, F.col("dataset") == F.col("of")).select("dataset", "block", "t", "own", "x", "first", "last")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("t")
        at = t.column("t").to_numpy()
        y = filtered_both_ways(t.column("x").to_numpy(), b, a, at[0] == t.column("first")[0].as_py(), at[-1] == t.column("last")[0].as_py())
        return t.select(["dataset", "t"]).append_column("filtered", pa.array(y)).filter(t.column("own"))

    return rows.groupBy("dataset", "block").applyInArrow(run, "dataset string, t long, filtered double")
