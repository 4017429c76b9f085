"""Queries over the driver's tables, one for each operator, and the same in SQL for DuckDB where SQL can say it.

Numbers that are sums of floating-point values are rounded to six places, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.functions import transforms as T
from lagweave.operators import links as L
from lagweave.operators.ci import CMIknn, CMIsymb, Data, GPDC, GSquared, OracleCI, PairwiseMultCI, ParCorr, ParCorrMult, ParCorrWLS, Question, RobustParCorr, symbols, with_margins
from lagweave.operators.embedding import column, lagged, sample
from lagweave.operators.mixed import CMIknnMixed, RegressionCI
from lagweave.operators.moments import moments
from lagweave.operators.significance import Bootstrapped, Shuffled, Thresholded
from lagweave.plans.effects import CausalEffects
from lagweave.plans.general import GeneralEffects, LeastSquares, Nearest, Standardised, natural_effects
from lagweave.plans.graphs import Adjustment, TimeGraph, ancestor_table, canonical, from_links, relevant_lag, reverse
from lagweave.plans.joint import JointDiscovery, RegimeDiscovery
from lagweave.plans.lpcmci import LatentDiscovery
from lagweave.plans.models import LinearModel, Mediation, Prediction, bootstrap_effects
from lagweave.plans.pcmci import Discovery, directed_member, windowed
from lagweave.sources.counterfactual import Model as CounterfactualModel
from lagweave.sources.counterfactual import natural_direct_effect, natural_indirect_effect
from lagweave.sources.files import described
from lagweave.sources.panel import Panel, event_days, event_hours, lineitem_days, order_weeks
from lagweave.sources.processes import context_model, ensemble, random_links

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Panels in SQL.
EVT_DAY = """ev AS (
  SELECT datediff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS t, event_type FROM events
), evt_day AS (
  SELECT CAST(d.t AS BIGINT) AS t, coalesce(click, 0.0) AS v0, coalesce(error, 0.0) AS v1, coalesce(purchase, 0.0) AS v2, coalesce(signup, 0.0) AS v3, coalesce(view, 0.0) AS v4
  FROM range((SELECT max(t) + 1 FROM ev)) d(t) LEFT JOIN (
    SELECT t, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS click, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS error,
      CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS purchase, CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) AS signup,
      CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS view
    FROM ev GROUP BY t) e ON d.t = e.t)"""
LI_DAY = """li AS (
  SELECT datediff('day', (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem), CAST(l_shipdate AS DATE)) AS t, l_quantity, l_extendedprice * (1 - l_discount) AS rev, l_returnflag AS f FROM lineitem
), li_day AS (
  SELECT CAST(d.t AS BIGINT) AS t, coalesce(q, 0.0) AS v0, coalesce(rev, 0.0) AS v1, coalesce(a, 0.0) AS v2, coalesce(n, 0.0) AS v3, coalesce(r, 0.0) AS v4
  FROM range((SELECT max(t) + 1 FROM li)) d(t) LEFT JOIN (
    SELECT t, sum(l_quantity) AS q, sum(rev) AS rev, CAST(count(*) FILTER (WHERE f = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE f = 'N') AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE f = 'R') AS DOUBLE) AS r
    FROM li GROUP BY t) s ON d.t = s.t)"""
EVT_HOUR = """ends AS (
  SELECT date_trunc('day', min(ts)) AS first, datediff('day', min(ts), max(ts)) + 1 AS days FROM events
), evt_hour AS (
  SELECT CAST(d.t AS BIGINT) AS t, v0, v1, v2, v3, v4 FROM range((SELECT 24 * days FROM ends)) d(t) LEFT JOIN (
    SELECT CAST(floor(date_diff('second', (SELECT CAST(first AS TIMESTAMP) FROM ends), ts) / 3600) AS BIGINT) AS t,
      avg(value) FILTER (WHERE event_type = 'click') AS v0, avg(value) FILTER (WHERE event_type = 'error') AS v1, avg(value) FILTER (WHERE event_type = 'purchase') AS v2,
      avg(value) FILTER (WHERE event_type = 'signup') AS v3, avg(value) FILTER (WHERE event_type = 'view') AS v4
    FROM events GROUP BY 1) e ON d.t = e.t)"""
ORD_SEG = """w AS (
  SELECT c_mktsegment AS segment, CAST(floor(datediff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) / 7) AS BIGINT) AS t, o_totalprice, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey
), ord_seg AS (
  SELECT s.segment AS dataset, CAST(d.t AS BIGINT) AS t, coalesce(n, 0.0) AS v0, coalesce(p, 0.0) AS v1, coalesce(u, 0.0) AS v2
  FROM (SELECT DISTINCT segment FROM w) s CROSS JOIN range((SELECT max(t) + 1 FROM w)) d(t)
  LEFT JOIN (SELECT segment, t, CAST(count(*) AS DOUBLE) AS n, sum(o_totalprice) AS p, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS u FROM w GROUP BY 1, 2) x
  ON x.segment = s.segment AND x.t = d.t)"""


# Formulas in SQL.
def sql_t_p(r: str, n: str, dim: str) -> str:
    """Two-sided p of a correlation: Student's distribution function as an integral of a power of the cosine, by Simpson's rule."""
    df = f"(({n}) - ({dim}))"
    theta = f"atan(abs({r}) / sqrt(1 - ({r}) * ({r})))"
    area = f"list_sum(list_transform(range(2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({theta} * k / 2000.0), {df} - 1))) * {theta} / 6000.0"
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {area})"


def sql_pcor(r: Callable[[str, str], str], x: str, y: str, z: list[str]) -> str:
    """Partial correlation as an expression of plain ones, condition by condition."""
    if not z:
        return r(x, y)
    xy, xz, yz = (sql_pcor(r, a, b, z[1:]) for a, b in ((x, y), (x, z[0]), (y, z[0])))
    return f"(({xy} - {xz} * {yz}) / sqrt((1 - {xz} * {xz}) * (1 - {yz} * {yz})))"


def sql_normal(u: str) -> str:
    """Acklam's approximation of the normal quantile."""
    c = "(((((-39.69683028665376 * w + 220.9460984245205) * w - 275.9285104469687) * w + 138.3577518672690) * w - 30.66479806614716) * w + 2.506628277459239) * (u - 0.5) / (((((-54.47609879822406 * w + 161.5858368580409) * w - 155.6989798598866) * w + 66.80131188771972) * w - 13.28068155288572) * w + 1)"
    e = "(((((-0.007784894002430293 * v - 0.3223964580411365) * v - 2.400758277161838) * v - 2.549732539343734) * v + 4.374664141464968) * v + 2.938163982698783) / ((((0.007784695709041462 * v + 0.3224671290700398) * v + 2.445134137142996) * v + 3.754408661907416) * v + 1)"
    c, e = (x.replace("w", f"(({u}) - 0.5) * (({u}) - 0.5)").replace("(u - 0.5)", f"(({u}) - 0.5)").replace("* v", f"* sqrt(-2 * ln(least({u}, 1 - ({u}))))") for x in (c, e))
    return f"(CASE WHEN least({u}, 1 - ({u})) >= 0.02425 THEN {c} WHEN ({u}) < 0.5 THEN {e} ELSE -({e}) END)"


def sql_lags(table: str, nodes: list[tuple[int, int]], first: int, by: str = "") -> str:
    """The rows from `first` on with a column for each node."""
    cols = ", ".join(f"v{v} AS x{v}_0" if not k else f"lag(v{v}, {-k}) OVER ({by}ORDER BY t) AS x{v}_{-k}" for v, k in nodes)
    return f"SELECT * FROM (SELECT t, {cols} FROM {table}) WHERE t >= {first}"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


def answers(spark: SparkSession, questions, got) -> DataFrame:
    return spark.createDataFrame([(k, float(a.val), float(a.p), int(a.n)) for k, a in enumerate(got)], "k int, val double, p double, n long")


# -- sources ------------------------------------------------------------------------------------------


@query(f"WITH {EVT_DAY} SELECT t, v0, v1, v2, v3, v4 FROM evt_day")
def panel_event_days(spark, d):
    return event_days(spark, d).df.drop("dataset")


@query(f"WITH {EVT_HOUR} SELECT t, {', '.join(f'round(v{i}, 6) AS v{i}' for i in range(5))} FROM evt_hour")
def panel_event_hours(spark, d):
    return event_hours(spark, d).df.select("t", *[r6(f"v{i}").alias(f"v{i}") for i in range(5)])


@query(f"WITH {LI_DAY} SELECT t, v0, round(v1, 4) AS v1, v2, v3, v4 FROM li_day")
def panel_lineitem_days(spark, d):
    return lineitem_days(spark, d).df.select("t", "v0", F.round("v1", 4).alias("v1"), "v2", "v3", "v4")


@query(f"WITH {ORD_SEG} SELECT dataset, t, v0, round(v1, 2) AS v1, v2 FROM ord_seg")
def panel_order_weeks(spark, d):
    return order_weeks(spark, d).df.select("dataset", "t", "v0", F.round("v1", 2).alias("v1"), "v2")


@query(f"WITH {EVT_DAY} SELECT t, CASE WHEN v0 = 70 THEN NULL ELSE v0 END AS v0, v1 > 60 AS m1, t + 5 AS shared FROM evt_day WHERE t + 5 IN (7, 9, 11, 20)")
def panel_options(spark, d):
    """Missing flag, mask, time offset and reference points."""
    df = event_days(spark, d).df.withColumns({"m0": F.lit(0), "m1": (F.col("v1") > 60).cast("int")})
    p = Panel.from_spark(df, "t", ["v0", "v1"], masks=["m0", "m1"], missing_flag=70, gapless=True, dataset="dataset", offsets={"0": 5, "1": 0}, anchors=[7, 9, 11, 20])
    return lagged_with_options(p)


def lagged_with_options(p: Panel) -> DataFrame:
    anchors = p.df.sparkSession.createDataFrame([(a,) for a in p.anchors], "shared long")
    return p.with_shared_time().join(F.broadcast(anchors), "shared", "left_semi").select("t", "v0", "m1", "shared")


# -- lag embedding ------------------------------------------------------------------------------------


@query(f"WITH {EVT_DAY}, e AS (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x0_1, v1 AS x1_0, lag(v2, 2) OVER (ORDER BY t) AS x2_2 FROM evt_day) SELECT * FROM e WHERE t >= 4")
def sample_2xtau_max(spark, d):
    return sample(event_days(spark, d), [(0, -1)], [(1, 0)], [(2, -2)], tau_max=2).df.drop("dataset")


@query(f"WITH {EVT_DAY}, e AS (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x0_1, v1 AS x1_0, lag(v2, 2) OVER (ORDER BY t) AS x2_2 FROM evt_day) SELECT * FROM e WHERE t >= 2")
def sample_max_lag(spark, d):
    return sample(event_days(spark, d), [(0, -1)], [(1, 0)], [(2, -2)], tau_max=3, cut_off="max_lag").df.drop("dataset")


@query(f"WITH {ORD_SEG}, e AS (SELECT dataset, t, lag(v0, 1) OVER (PARTITION BY dataset ORDER BY t) AS x0_1, v2 AS x2_0 FROM ord_seg) SELECT * FROM e WHERE t >= 2")
def sample_many_datasets(spark, d):
    return sample(order_weeks(spark, d), [(0, -1)], [(2, 0)], tau_max=1).df


@query(f"WITH {EVT_HOUR}, e AS (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x0_1, v1 AS x1_0 FROM evt_hour) SELECT t, round(x0_1, 6) AS x0_1, round(x1_0, 6) AS x1_0 FROM e WHERE t >= 2 AND x0_1 IS NOT NULL AND x1_0 IS NOT NULL")
def sample_missing(spark, d):
    return sample(event_hours(spark, d), [(0, -1)], [(1, 0)], tau_max=1).df.select("t", r6("x0_1").alias("x0_1"), r6("x1_0").alias("x1_0"))


@query(
    f"""WITH {EVT_HOUR}, e AS (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x0_1, v1 AS x1_0 FROM evt_hour),
    f AS (SELECT *, max(CASE WHEN x0_1 IS NULL OR x1_0 IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS bad FROM e WHERE t >= 2)
    SELECT t, round(x0_1, 6) AS x0_1, round(x1_0, 6) AS x1_0 FROM f WHERE bad = 0"""
)
def sample_missing_spread(spark, d):
    return sample(event_hours(spark, d), [(0, -1)], [(1, 0)], tau_max=1, spread_missing=True).df.select("t", r6("x0_1").alias("x0_1"), r6("x1_0").alias("x1_0"))


@query(f"WITH {EVT_DAY}, e AS (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x0_1, v1 AS x1_0 FROM evt_day) SELECT * FROM e WHERE t >= 2 AND NOT x1_0 > 66")
def sample_masked(spark, d):
    df = event_days(spark, d).df.withColumns({"m0": F.col("v0") > 66, "m1": F.col("v1") > 66})
    p = Panel.from_spark(df, "t", ["v0", "v1"], masks=["m0", "m1"], gapless=True)
    return sample(p, [(0, -1)], [(1, 0)], tau_max=1, mask_type="y").df.drop("dataset")


@query(f"WITH {EVT_DAY}, e AS (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x0_1, lag(v3, 2) OVER (ORDER BY t) AS x3_2, v1 AS x1_0 FROM evt_day) SELECT * FROM e WHERE t >= 4")
def sample_vector_variable(spark, d):
    p = event_days(spark, d)
    p.vectors = {5: [(0, -1), (3, -2)]}
    return sample(p, [(5, 0)], [(1, 0)], tau_max=2).df.drop("dataset")


# -- transforms ---------------------------------------------------------------------------------------


@query(f"WITH {LI_DAY} " + " UNION ALL ".join(["SELECT CAST(0 AS INTEGER) AS lag, 1.0::DOUBLE AS r"] + [f"SELECT {k}, round(corr(v0, l), 6) FROM (SELECT v0, lag(v0, {k}) OVER (ORDER BY t) AS l FROM li_day)" for k in range(1, 8)]))
def autocorrelation(spark, d):
    return T.autocorrelation(lineitem_days(spark, d).df, "v0", 7).select("lag", r6("r").alias("r"))


@query()
def block_length(spark, d):
    df = lineitem_days(spark, d).df
    n = df.count()
    r = [x["r"] for x in T.autocorrelation(df, "v0", max(5, n // 10)).orderBy("lag").collect()]
    return spark.createDataFrame([(T.block_length(np.array(r), n),)], "block_length int")


@query(f"WITH {LI_DAY} SELECT t, round(avg(v0) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed FROM li_day")
def smooth_heaviside(spark, d):
    return T.smooth(lineitem_days(spark, d).df, "v0", 8).select("t", r6("smoothed").alias("smoothed"))


@query(f"WITH {LI_DAY} SELECT a.t, round(sum(exp(-power(a.t - b.t, 2) / 9.0) * b.v0) / sum(exp(-power(a.t - b.t, 2) / 9.0)), 6) AS smoothed FROM li_day a JOIN li_day b ON abs(a.t - b.t) <= 27 GROUP BY a.t")
def smooth_gaussian(spark, d):
    return T.smooth(lineitem_days(spark, d).df, "v0", 3, "gaussian").select("t", r6("smoothed").alias("smoothed"))


@query(f"WITH {LI_DAY}, s AS (SELECT sum(v0 * v2) / sum(v2) AS m, sum(v2 * v0 * v0) / sum(v2) AS q FROM li_day) SELECT round(m, 4) AS mean, round(sqrt(q - m * m), 4) AS std FROM s")
def weighted_mean_std(spark, d):
    mean, std = T.weighted_mean_std("v0", "v2")
    return lineitem_days(spark, d).df.agg(F.round(mean, 4).alias("mean"), F.round(std, 4).alias("std"))


@query(f"WITH {EVT_DAY} SELECT t // 7 AS t, round(avg(v0), 6) AS v0, round(avg(v1), 6) AS v1 FROM evt_day WHERE t // 7 < 4 GROUP BY 1")
def time_bins(spark, d):
    return T.time_bins(event_days(spark, d).df, ["v0", "v1"], 7).select("t", r6("v0").alias("v0"), r6("v1").alias("v1"))


@query(f"WITH {LI_DAY} SELECT t, round(cume_dist() OVER (ORDER BY v0), 9) AS u FROM li_day")
def uniform_transform(spark, d):
    return T.uniform(lineitem_days(spark, d).df, "v0").select("t", F.round("uniform", 9).alias("u"))


@query(f"WITH {LI_DAY}, u AS (SELECT t, CASE WHEN cume_dist() OVER (ORDER BY v0) >= 1 THEN 0.999 ELSE cume_dist() OVER (ORDER BY v0) END AS q FROM li_day) SELECT t, round({sql_normal('q')}, 6) AS z FROM u")
def normal_transform(spark, d):
    return T.normal_scores(lineitem_days(spark, d).df, "v0").select("t", r6("score").alias("z"))


@query(f"WITH {LI_DAY} SELECT t, CAST(row_number() OVER (ORDER BY v0, t) - 1 AS INTEGER) AS r FROM li_day")
def rank_transform(spark, d):
    return T.ranks(lineitem_days(spark, d).df, "v0").select("t", F.col("ranked").cast("int").alias("r"))


@query(f"WITH {LI_DAY} SELECT t, round((v0 - avg(v0) OVER ()) / stddev_pop(v0) OVER (), 6) AS z, round((v0 - min(v0) OVER ()) / (max(v0) OVER () - min(v0) OVER ()), 6) AS s FROM li_day")
def standardised(spark, d):
    return T.scaled(T.standardised(lineitem_days(spark, d).df, "v0"), "v0").select("t", r6("standardised").alias("z"), r6("scaled").alias("s"))


@query(
    f"""WITH {LI_DAY}, e AS (SELECT t, v0 AS a, lead(v0, 2) OVER (ORDER BY t) AS b, lead(v0, 4) OVER (ORDER BY t) AS c FROM li_day)
    SELECT t, CAST((a < b)::INT + 2 * (a < c)::INT + 2 * (b < c)::INT AS INTEGER) AS pattern FROM e WHERE c IS NOT NULL"""
)
def ordinal_patterns(spark, d):
    return T.ordinal_patterns(lineitem_days(spark, d).df, "v0", 3, 2).select("t", "pattern")


@query(
    f"""WITH {LI_DAY}, e AS (SELECT t, v0, (row_number() OVER (ORDER BY v0) - 1) % CAST(ceil((SELECT count(*) FROM li_day) / 6.0) AS BIGINT) = 0 AS edge FROM li_day)
    SELECT t, CAST(sum(edge::INT) OVER (ORDER BY v0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS symbol FROM e"""
)
def quantile_bins(spark, d):
    return T.quantile_bins(lineitem_days(spark, d).df, "v0", 6).select("t", "symbol")


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT::DOUBLE AS f_0, (l_returnflag = 'N')::INT::DOUBLE AS f_1, (l_returnflag = 'R')::INT::DOUBLE AS f_2 FROM lineitem")
def one_hot(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("f"))
    return T.one_hot(df, "f", ["A", "N", "R"]).drop("f")


@query(f"WITH {ORD_SEG} SELECT dataset, t, round(v0 - avg(v0) OVER (PARTITION BY dataset), 6) AS by_set, round(v0 - avg(v0) OVER (PARTITION BY t), 6) AS by_time FROM ord_seg")
def dummy_demeaning(spark, d):
    """What regressing on dataset (or time) dummies leaves."""
    df = T.demeaned(T.demeaned(order_weeks(spark, d).df, "v0", ["dataset"], "by_set"), "v0", ["t"], "by_time")
    return df.select("dataset", "t", r6("by_set").alias("by_set"), r6("by_time").alias("by_time"))


def _filter_sql(kind: str) -> str:
    """The filter as a recursion over its difference equation, forward over the odd extension, then back."""
    b, a = T.butterworth(2 / 14, kind == "high")
    rest = T.Recursion(b, a).steady
    lit = lambda x: f"({float(x)!r}::DOUBLE)"

    def once(name: str, source: str) -> str:
        after = lambda x, y, z: ", ".join([f"{z[1]} + {lit(b[1])} * {x} - {lit(a[1])} * ({y})", f"{z[2]} + {lit(b[2])} * {x} - {lit(a[2])} * ({y})", f"{lit(b[3])} * {x} - {lit(a[3])} * ({y})"])
        first, then = [f"{lit(r)} * x" for r in rest], ["z0", "z1", "z2"]
        y0, y1 = f"{lit(b[0])} * x + {first[0]}", f"{lit(b[0])} * s.x + z0"
        return f"{name}(i, y, z0, z1, z2) AS (SELECT i, {y0}, {after('x', y0, first)} FROM {source} WHERE i = 0 UNION ALL SELECT s.i, {y1}, {after('s.x', y1, then)} FROM {name} f JOIN {source} s ON s.i = f.i + 1)"

    return f"""WITH RECURSIVE {LI_DAY}, m AS (SELECT max(t) AS last FROM li_day), e AS (
      SELECT CAST(12 + t AS BIGINT) AS i, v0 AS x FROM li_day
      UNION ALL SELECT 12 - t, 2 * (SELECT v0 FROM li_day WHERE t = 0) - v0 FROM li_day WHERE t BETWEEN 1 AND 12
      UNION ALL SELECT 12 + 2 * last - t, 2 * (SELECT v0 FROM li_day, m WHERE t = last) - v0 FROM li_day, m WHERE t BETWEEN last - 12 AND last - 1
    ), {once('forth', 'e')}, r AS (SELECT 24 + last - i AS i, y AS x FROM forth, m), {once('back', 'r')}
    SELECT CAST(12 + last - i AS BIGINT) AS t, round(y, 6) AS filtered FROM back, m WHERE 12 + last - i BETWEEN 0 AND last"""


@query(_filter_sql("low"))
def low_pass(spark, d):
    return T.pass_filter(lineitem_days(spark, d).df, "v0", 14, "low").select("t", r6("filtered").alias("filtered"))


@query(_filter_sql("high"))
def high_pass(spark, d):
    return T.pass_filter(lineitem_days(spark, d).df, "v0", 14, "high").select("t", r6("filtered").alias("filtered"))


# -- moments and tests --------------------------------------------------------------------------------

_N5 = [(v, -k) for v in range(2) for k in range(3)]


@query(
    f"WITH {EVT_DAY}, e AS (SELECT t, "
    + ", ".join(f"lag(v{v}, {-k}) OVER (ORDER BY t) AS x{v}_{-k}" for v, k in _N5)
    + " FROM evt_day), f AS (SELECT * FROM e WHERE t >= 4) "
    + " UNION ALL ".join(f"SELECT CAST({a} AS INTEGER) AS i, CAST({b} AS INTEGER) AS j, round(covar_pop(x{p[0]}_{-p[1]}, x{q[0]}_{-q[1]}), 6) AS cov FROM f" for a, p in enumerate(_N5) for b, q in enumerate(_N5))
)
def moment_matrix(spark, d):
    m = moments(lagged(event_days(spark, d), _N5, 4), _N5)[()]
    return spark.createDataFrame([(a, b, float(m.cov[a, b])) for a in range(6) for b in range(6)], "i int, j int, cov double").withColumn("cov", r6("cov"))


@query(
    f"WITH {EVT_DAY}, c AS ("
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, CAST({k} AS INTEGER) AS tau, corr(x, y) AS r, count(*) AS n FROM (SELECT t, lag(v{i}, {k}) OVER (ORDER BY t) AS x, v{j} AS y FROM evt_day) WHERE t >= 4" for i in range(5) for j in range(5) for k in range(1, 3)
    )
    + f") SELECT i, j, tau, round(r, 6) AS val, round({sql_t_p('r', 'n', '2')}, 6) AS p FROM c"
)
def lagged_dependencies(spark, d):
    f = Discovery(event_days(spark, d)).momentary(2, 1, kind="pair")
    return f.links(spark).where("tau > 0").select("i", "j", "tau", r6("val").alias("val"), r6("p").alias("p"))


_ONE = f"WITH {EVT_DAY}, e AS (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x, v1 AS y, lag(v1, 1) OVER (ORDER BY t) AS z FROM evt_day), c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM e WHERE t >= 2), r AS (SELECT (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r, n FROM c)"


@query(f"{_ONE} SELECT CAST(0 AS INTEGER) AS k, round(r, 6) AS val, round({sql_t_p('r', 'n', '3')}, 6) AS p, n FROM r")
def partial_correlation(spark, d):
    q = [Question(((0, -1),), ((1, 0),), ((1, -1),))]
    return answers(spark, q, ParCorr().run(Data(event_days(spark, d), 1), q)).select("k", r6("val").alias("val"), r6("p").alias("p"), "n")


@query(f"{_ONE} SELECT CAST(0 AS INTEGER) AS k, round(r, 6) AS val, CASE WHEN abs(r) >= 0.1 THEN 0.0 ELSE 1.0 END AS p, n FROM r")
def fixed_threshold(spark, d):
    q = [Question(((0, -1),), ((1, 0),), ((1, -1),))]
    return answers(spark, q, Thresholded(ParCorr(), 0.1).run(Data(event_days(spark, d), 1), q)).select("k", r6("val").alias("val"), "p", "n")


@query(f"{_ONE} SELECT CAST(0 AS INTEGER) AS k, round(r, 6) AS val, n FROM r")
def block_shuffle_test(spark, d):
    """The value; p comes from 500 shuffled samples, of which SQL knows nothing (tests hold it to the analytic one)."""
    q = [Question(((0, -1),), ((1, 0),), ((1, -1),))]
    return answers(spark, q, Shuffled(ParCorr()).run(Data(event_days(spark, d), 1), q)).select("k", r6("val").alias("val"), "n")


@query()
def block_bootstrap_interval(spark, d):
    q = [Question(((0, -1),), ((1, 0),), ((1, -1),))]
    a = Bootstrapped(ParCorr(), 0.9, 200).run(Data(lineitem_days(spark, d), 1), q)[0]
    return spark.createDataFrame([(a.val, *a.conf)], "val double, low double, high double").select(*[r6(c).alias(c) for c in ("val", "low", "high")])


@query(f"{_ONE} SELECT CAST(0 AS INTEGER) AS k, round(-n * ln(1 - r * r), 6) AS val, n FROM r")
def regression_test(spark, d):
    """Of numbers: the likelihood ratio of two least-squares models."""
    q = [Question(((0, -1),), ((1, 0),), ((1, -1),))]
    return answers(spark, q, RegressionCI().run(Data(event_days(spark, d), 1), q)).select("k", r6("val").alias("val"), "n")


def _mixed(spark, d) -> Panel:
    """Events as plain rows: type (categories), value and hour of day; whole table."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kinds = ["click", "error", "purchase", "signup", "view"]
    code = sum((F.when(F.col("event_type") == k, float(i)).otherwise(0.0) for i, k in enumerate(kinds)), F.lit(0.0))
    return Panel.from_spark(e.select(F.col("event_id").alias("t"), code.alias("type"), "value", F.hour("ts").cast("double").alias("h")), "t", ["type", "value", "h"], gapless=True, discrete=["type"])


@query(
    """WITH g AS (SELECT event_type AS k, count(*) AS n, sum(value) AS s, sum(hour(ts)) AS sh, sum(value * value) AS vv, sum(value * hour(ts)) AS vh, sum(hour(ts) * hour(ts)) AS hh FROM events GROUP BY 1),
    whole AS (SELECT sum(n) AS n, sum(vv) - sum(s) * sum(s) / sum(n) AS vv, sum(vh) - sum(s) * sum(sh) / sum(n) AS vh, sum(hh) - sum(sh) * sum(sh) / sum(n) AS hh, sum(vv - s * s / n) AS wv, sum(vh - s * sh / n) AS wc, sum(hh - sh * sh / n) AS wh FROM g)
    SELECT CAST(n AS BIGINT) AS n, round(n * ln((vv - vh * vh / hh) / (wv - wc * wc / wh)), 4) AS val FROM whole"""
)
def regression_test_mixed(spark, d):
    """Event type against value given the hour: least squares with and without the type."""
    q = [Question(((0, 0),), ((1, 0),), ((2, 0),))]
    a = RegressionCI().run(Data(_mixed(spark, d), 0), q)[0]
    return spark.createDataFrame([(a.n, a.val)], "n long, val double").withColumn("val", F.round("val", 4))


@query()
def cmi_mixed(spark, d):
    """Days above the median of clicks (categories) against purchases: three estimators."""
    days = event_days(spark, d).df
    mid = days.agg(F.median("v0").alias("mid"))
    p = Panel.from_spark(days.crossJoin(F.broadcast(mid)).select("t", (F.col("v0") > F.col("mid")).cast("double").alias("c"), "v2", "v1"), "t", ["c", "v2", "v1"], gapless=True, discrete=["c"])  # one row of a median
    q, data = [Question(((0, 0),), ((1, 0),), ((2, 0),))], Data(p, 0)
    rows = [(e, float((a := CMIknnMixed(5, e, samples=100).run(data, q)[0]).val), float(a.p)) for e in ("MS", "MSinf", "ZMADG")]
    return spark.createDataFrame(rows, "estimator string, val double, p double").select("estimator", r6("val").alias("val"), r6("p").alias("p"))


def _sample_test(test):
    def run(spark, d):
        q = [Question(((0, -1),), ((1, 0),), ((1, -1),)), Question(((2, 0),), ((3, 0),), ())]
        return answers(spark, q, test.run(Data(event_days(spark, d), 1), q)).select("k", r6("val").alias("val"), r6("p").alias("p"), "n")

    return run


for _name, _test in (("robust_partial_correlation", RobustParCorr()), ("weighted_partial_correlation", ParCorrWLS()), ("cmi_nearest_neighbours", CMIknn(samples=50)), ("gp_distance_correlation", GPDC(samples=100))):
    QUERIES[_name] = _sample_test(_test)

#: The two questions' samples: x, y and, for the first, z.
_TWO = f"{EVT_DAY}, e0 AS (SELECT * FROM (SELECT t, lag(v0, 1) OVER (ORDER BY t) AS x, v1 AS y, lag(v1, 1) OVER (ORDER BY t) AS z FROM evt_day) WHERE t >= 2), e1 AS (SELECT t, v2 AS x, v3 AS y FROM evt_day WHERE t >= 2)"
_U = lambda c: f"CASE WHEN cume_dist() OVER (ORDER BY {c}) >= 1 THEN 1 - 1e-5 ELSE cume_dist() OVER (ORDER BY {c}) END"
ORACLES["robust_partial_correlation"] = f"""WITH {_TWO},
    u0 AS (SELECT {_U('x')} AS x, {_U('y')} AS y, {_U('z')} AS z FROM e0), u1 AS (SELECT {_U('x')} AS x, {_U('y')} AS y FROM e1),
    g0 AS (SELECT {sql_normal('x')} AS x, {sql_normal('y')} AS y, {sql_normal('z')} AS z FROM u0), g1 AS (SELECT {sql_normal('x')} AS x, {sql_normal('y')} AS y FROM u1),
    c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM g0),
    r AS (SELECT 0 AS k, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r, n, 3 AS dim FROM c UNION ALL SELECT 1, corr(x, y), count(*), 2 FROM g1)
    SELECT CAST(k AS INTEGER) AS k, round(r, 6) AS val, round({sql_t_p('r', 'n', 'dim')}, 6) AS p, n FROM r"""
_Z = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}"
_SPREAD = lambda c: f"CASE WHEN row_number() OVER (ORDER BY t) < 10 THEN 1.0 ELSE avg(abs({c})) OVER (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END"
ORACLES["weighted_partial_correlation"] = f"""WITH {_TWO},
    s0 AS (SELECT t, {_Z('x')}, {_Z('y')}, {_Z('z')} FROM e0), s1 AS (SELECT t, {_Z('x')}, {_Z('y')} FROM e1),
    b0 AS (SELECT sum(x * z) / sum(z * z) AS bx, sum(y * z) / sum(z * z) AS by_ FROM s0), p0 AS (SELECT t, x, y, z, x - bx * z AS rx, y - by_ * z AS ry FROM s0, b0),
    w0 AS (SELECT t, x, y, z, {_SPREAD('rx')} AS sx, {_SPREAD('ry')} AS sy FROM p0), w1 AS (SELECT t, x, y, {_SPREAD('x')} AS sx, {_SPREAD('y')} AS sy FROM s1),
    c0 AS (SELECT sum(x * z / (sx * sx)) / sum(z * z / (sx * sx)) AS bx, sum(y * z / (sy * sy)) / sum(z * z / (sy * sy)) AS by_ FROM w0),
    r AS (SELECT 0 AS k, corr((x - bx * z) / sx, (y - by_ * z) / sy) AS r, count(*) AS n, 3 AS dim FROM w0, c0 UNION ALL SELECT 1, corr(x / sx, y / sy), count(*), 2 FROM w1)
    SELECT CAST(k AS INTEGER) AS k, round(r, 6) AS val, round({sql_t_p('r', 'n', 'dim')}, 6) AS p, n FROM r"""


_M5 = [(0, 0), (1, 0), (2, 0), (3, 0), (4, -1)]
_R4 = lambda a, b: f"r{min(a, b)}{max(a, b)}" if a != b else "1.0"


def _det(rows: list[int], r=_R4) -> str:
    """Determinant of a correlation matrix, expanded."""
    def minor(left: list[int], top: list[int]) -> str:
        if not left:
            return "1.0"
        return "(" + " + ".join(f"{'-' if k % 2 else ''}1 * {r(left[0], c)} * {minor(left[1:], top[:k] + top[k + 1 :])}" for k, c in enumerate(top)) + ")"

    return minor(rows, rows)


@query(
    f"WITH {EVT_DAY}, e AS ({sql_lags('evt_day', _M5, 2)}), c AS (SELECT count(*) AS n, "
    + ", ".join(f"corr(x{a}_{'1' if a == 4 else '0'}, x{b}_{'1' if b == 4 else '0'}) AS c{a}{b}" for a in range(5) for b in range(a + 1, 5))
    + " FROM e), r AS (SELECT n, "
    + ", ".join(f"(c{a}{b} - c{a}4 * c{b}4) / sqrt((1 - c{a}4 * c{a}4) * (1 - c{b}4 * c{b}4)) AS r{a}{b}" for a in range(4) for b in range(a + 1, 4))
    + f""" FROM c), top AS (SELECT n, r FROM (SELECT n, unnest([r02, r03, r12, r13]) AS r FROM r) ORDER BY abs(r) DESC LIMIT 1), l AS (SELECT n, {_det([0, 1, 2, 3])} / ({_det([0, 1])} * {_det([2, 3])}) AS lambda_ FROM r),
    x AS (SELECT lambda_, -(n - 1 - 2.5) * ln(lambda_) AS chi FROM l)
    SELECT 'max_corr' AS test, round(r, 6) AS val, round(least(1.0, 4 * {sql_t_p('r', 'n', '5')}), 6) AS p FROM top
    UNION ALL SELECT 'wilks', round(lambda_, 6), round(exp(-chi / 2) * (1 + chi / 2), 6) FROM x
    UNION ALL SELECT 'pairwise', round(r, 6), round(least(1.0, 4 * {sql_t_p('r', 'n', '3')}), 6) FROM top"""
)
def multivariate_correlation(spark, d):
    q = [Question(((0, 0), (1, 0)), ((2, 0), (3, 0)), ((4, -1),))]
    data = Data(event_days(spark, d), 1)
    rows = [(t, a.val, a.p) for t, test in (("max_corr", ParCorrMult()), ("wilks", ParCorrMult("wilks")), ("pairwise", PairwiseMultCI())) for a in test.run(data, q)]
    return spark.createDataFrame(rows, "test string, val double, p double").select("test", r6("val").alias("val"), r6("p").alias("p"))


def _flags(spark, d) -> Data:
    """Return flag, line status and line number as symbols; rows are the panel's times."""
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    code = lambda c, ks: sum((F.when(F.col(c) == k, float(i)).otherwise(0.0) for i, k in enumerate(ks)), F.lit(0.0))
    df = df.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("t"), code("l_returnflag", "ANR").alias("x"), code("l_linestatus", "FO").alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    return Data(Panel.from_spark(df, "t", ["x", "y", "z"], gapless=True), 0)


_XYZ = "SELECT l_returnflag AS x, l_linestatus AS y, l_linenumber AS z, count(*) AS c FROM lineitem GROUP BY 1, 2, 3"
_MARGINS = f"WITH c AS ({_XYZ}), m AS (SELECT *, sum(c) OVER (PARTITION BY x, z) AS xz, sum(c) OVER (PARTITION BY y, z) AS yz, sum(c) OVER (PARTITION BY z) AS nz, sum(c) OVER () AS n FROM c)"


@query(f"{_MARGINS} SELECT round(sum(c / n * ln(c * nz / (xz * yz))), 9) AS cmi, round(2 * sum(c * ln(c * nz / (xz * yz))), 6) AS g FROM m")
def contingency_tests(spark, d):
    """Conditional mutual information and the likelihood ratio of two flags given the line number."""
    q = [Question(((0, 0),), ((1, 0),), ((2, 0),))]
    data = _flags(spark, d)
    a, b = CMIsymb(0).run(data, q)[0], GSquared().run(data, q)[0]
    return spark.createDataFrame([(a.val, b.val)], "cmi double, g double").select(F.round("cmi", 9).alias("cmi"), r6("g").alias("g"))


@query(f"{_MARGINS} SELECT CAST(z AS DOUBLE) AS z, CAST(sum(c) AS BIGINT) AS c, CAST(max(nz) AS BIGINT) AS n_z FROM m GROUP BY z")
def contingency_margins(spark, d):
    m = with_margins(symbols(_flags(spark, d), [Question(((0, 0),), ((1, 0),), ((2, 0),))]))
    return m.groupBy(F.col("z.n0").alias("z")).agg(F.sum("c").alias("c"), F.max("n_z").alias("n_z"))


_SYMBOL = lambda c, out: f"""SELECT t, CAST(sum(edge::INT) OVER (ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS {out} FROM (SELECT t, {c}, (row_number() OVER (ORDER BY {c}) - 1) % CAST(ceil((SELECT count(*) FROM li_day) / 4.0) AS BIGINT) = 0 AS edge FROM li_day)"""


@query(
    f"""WITH {LI_DAY}, a AS ({_SYMBOL('v0', 'a')}), b AS ({_SYMBOL('v2', 'b')}), e AS (SELECT t, lag(a, 1) OVER (ORDER BY t) AS x, b AS y, lag(b, 1) OVER (ORDER BY t) AS z FROM a JOIN b USING (t)),
    c AS (SELECT x, y, z, count(*) AS c FROM e WHERE t >= 2 GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY x, z) AS xz, sum(c) OVER (PARTITION BY y, z) AS yz, sum(c) OVER (PARTITION BY z) AS nz, sum(c) OVER () AS n FROM c)
    SELECT CAST(0 AS INTEGER) AS k, round(sum(c / n * ln(c * nz / (xz * yz))), 6) AS val, CAST(max(n) AS BIGINT) AS n FROM m"""
)
def symbolic_information(spark, d):
    return symbolic_permutation_test(spark, d, 0).select("k", "val", "n")


@query()
def symbolic_permutation_test(spark, d, samples=100):
    df = T.quantile_bins(lineitem_days(spark, d).df, "v0", 4).withColumn("a", F.col("symbol").cast("double")).select("dataset", "t", "a", "v2")
    df = T.quantile_bins(df, "v2", 4).select("t", "a", F.col("symbol").cast("double").alias("b"))
    q = [Question(((0, -1),), ((1, 0),), ((1, -1),))]
    return answers(spark, q, CMIsymb(samples).run(Data(Panel.from_spark(df, "t", ["a", "b"], gapless=True), 1), q)).select("k", r6("val").alias("val"), r6("p").alias("p"), "n")


@query("SELECT CAST(k AS INTEGER) AS k, CAST(val AS DOUBLE) AS val, CAST(p AS DOUBLE) AS p, CAST(0 AS BIGINT) AS n FROM (VALUES (0, 1.0, 0.0), (1, 0.0, 1.0), (2, 0.0, 1.0)) q(k, val, p)")
def oracle_separation(spark, d):
    """0 -> 1 -> 2 with 0 and 1 on their own past: dependent; apart given 1; apart given the past between."""
    o = OracleCI({0: [(0, -1)], 1: [(0, -1), (1, -1)], 2: [(1, 0)]})
    q = [Question(((0, -1),), ((2, 0),)), Question(((0, -1),), ((2, 0),), ((1, 0),)), Question(((0, -2),), ((1, 0),), ((0, -1), (1, -1)))]
    return answers(spark, q, o.run(None, q))


# -- links --------------------------------------------------------------------------------------------

#: A links table from whole numbers of the nation table: no arithmetic that could round.
_LINKS = "SELECT CAST(a.n_nationkey % 5 AS INTEGER) AS i, CAST(a.n_nationkey // 5 AS INTEGER) AS j, CAST(b.n_nationkey AS INTEGER) AS tau, ((a.n_nationkey * 37 + b.n_nationkey * 11) % 101) / 256.0 AS val, ((a.n_nationkey * 53 + b.n_nationkey * 29) % 97 + 1) / 512.0 AS p FROM nation a JOIN nation b ON b.n_nationkey < 3 WHERE NOT (a.n_nationkey % 5 = a.n_nationkey // 5 AND b.n_nationkey = 0)"


def _links(spark, d) -> DataFrame:
    a = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("a"))
    b = a.where("a < 3").withColumnRenamed("a", "b")
    df = a.crossJoin(F.broadcast(b)).where("NOT (a % 5 = a div 5 AND b = 0)")  # 25 by 3 rows
    return df.selectExpr("CAST(a % 5 AS INT) i", "CAST(a div 5 AS INT) j", "CAST(b AS INT) tau", "CAST((a * 37 + b * 11) % 101 AS DOUBLE) / 256 AS val", "CAST((a * 53 + b * 29) % 97 + 1 AS DOUBLE) / 512 AS p")


@query(
    f"""WITH l AS ({_LINKS}), k AS (SELECT *, tau > 0 AS counted FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY counted ORDER BY p, i, j, tau) AS k, count(*) OVER (PARTITION BY counted) AS m FROM k),
    q AS (SELECT *, least(1.0, min(p * m / k) OVER (PARTITION BY counted ORDER BY p DESC, i DESC, j DESC, tau DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS b FROM r)
    SELECT i, j, tau, round(CASE WHEN counted THEN b ELSE p END, 9) AS q FROM q"""
)
def false_discovery_rate(spark, d):
    return L.fdr(_links(spark, d)).select("i", "j", "tau", F.round("q", 9).alias("q"))


_SYM = f"l AS ({_LINKS}), s AS (SELECT a.i, a.j, a.tau, CASE WHEN a.tau = 0 AND (b.p > a.p OR (b.p = a.p AND (abs(b.val) > abs(a.val) OR (abs(b.val) = abs(a.val) AND b.i > a.i)))) THEN b.val ELSE a.val END AS val, CASE WHEN a.tau = 0 THEN greatest(a.p, b.p) ELSE a.p END AS p FROM l a JOIN l b ON b.tau = a.tau AND ((a.tau = 0 AND b.i = a.j AND b.j = a.i) OR (a.tau > 0 AND b.i = a.i AND b.j = a.j)))"


@query(f"WITH {_SYM} SELECT i, j, tau, CAST(val AS DOUBLE) AS val, CAST(p AS DOUBLE) AS p FROM s")
def symmetric_links(spark, d):
    return L.symmetric(_links(spark, d)).select("i", "j", "tau", "val", "p")


@query(
    f"""WITH l AS ({_LINKS}) SELECT a.i, a.j, a.tau, CASE WHEN a.tau > 0 AND a.p <= 0.1 THEN '-->' WHEN a.tau > 0 THEN '' WHEN a.p <= 0.1 AND b.p <= 0.1 THEN 'o-o' WHEN a.p <= 0.1 THEN '-->' WHEN b.p <= 0.1 THEN '<--' ELSE '' END AS link
    FROM l a LEFT JOIN l b ON a.tau = 0 AND b.tau = 0 AND b.i = a.j AND b.j = a.i"""
)
def marked_links(spark, d):
    return L.marked(_links(spark, d), 0.1).select("i", "j", "tau", "link")


@query(f"WITH l AS ({_LINKS}) SELECT j, string_agg(CAST(i * 10 + tau AS VARCHAR), ',' ORDER BY abs(val) DESC, tau, i) AS parents FROM l WHERE tau > 0 AND p <= 0.1 GROUP BY j")
def parents_of(spark, d):
    return L.parents(L.marked(_links(spark, d), 0.1).where("tau > 0")).select("j", F.array_join(F.transform("parents", lambda x: (x["i"] * 10 + x["tau"]).cast("string")), ",").alias("parents"))


@query(
    f"""WITH RECURSIVE l AS ({_LINKS}), e AS (SELECT i, j, tau FROM l WHERE tau > 0 AND p <= 0.1),
    reach(variable, ancestor, back) AS (SELECT j, i, tau FROM e UNION SELECT r.variable, e.i, r.back + e.tau FROM reach r JOIN e ON e.j = r.ancestor WHERE r.back + e.tau <= 4)
    SELECT DISTINCT variable, CAST(0 AS INTEGER) AS lag, ancestor, CAST(-back AS INTEGER) AS ancestor_lag FROM reach"""
)
def ancestors(spark, d):
    return ancestor_table(L.marked(_links(spark, d), 0.1).where("tau > 0"), 4).select("variable", "lag", "ancestor", F.col("ancestor_lag").cast("int").alias("ancestor_lag"))


@query(
    f"""WITH l AS ({_LINKS}), e AS (SELECT i, j, tau FROM l WHERE p <= 0.03 AND (tau > 0 OR i < j)), a AS (SELECT i, j FROM e UNION SELECT j, i FROM e)
    SELECT DISTINCT x.i, x.j AS k, y.j FROM a x JOIN a y ON y.i = x.j AND y.j <> x.i AND x.i <> x.j AND y.i <> y.j WHERE NOT EXISTS (SELECT 1 FROM a z WHERE z.i = x.i AND z.j = y.j)"""
)
def unshielded_triples(spark, d):
    """Pairs of links that meet while their ends are not adjacent, lags set aside: a join and an anti join."""
    e = _links(spark, d).where("p <= 0.03 AND (tau > 0 OR i < j)").select("i", "j")
    a = e.union(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    x, y = a.select("i", F.col("j").alias("k")).where("i <> k"), a.select(F.col("i").alias("k"), "j").where("k <> j")
    return x.join(y, "k").where("i <> j").join(a, ["i", "j"], "left_anti").select("i", "k", "j").distinct()


@query(
    f"""WITH l AS ({_LINKS}), runs AS (SELECT i, j, tau, r.n_nationkey AS run, val + r.n_nationkey / 1024.0 AS val, CASE WHEN (i * 3 + j * 5 + tau + r.n_nationkey) % 7 < 3 THEN '-->' WHEN (i + r.n_nationkey) % 3 = 0 THEN 'o-o' ELSE '' END AS link FROM l JOIN nation r ON r.n_nationkey < 8),
    n AS (SELECT i, j, tau, link, count(*) AS c FROM runs GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY i, j, tau ORDER BY c DESC, CASE link WHEN '' THEN 0 WHEN 'x-x' THEN 1 WHEN 'o-o' THEN 2 ELSE 3 END, link) AS r FROM n),
    v AS (SELECT i, j, tau, avg(val) AS mean, quantile_cont(val, 0.05) AS low, quantile_cont(val, 0.95) AS high FROM runs GROUP BY ALL)
    SELECT i, j, tau, link, c / 8 AS frequency, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM top JOIN v USING (i, j, tau) WHERE r = 1"""
)
def run_summary(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 8").select(F.col("n_nationkey").alias("run"))
    runs = _links(spark, d).crossJoin(F.broadcast(n)).selectExpr("i", "j", "tau", "run", "val + run / 1024 AS val", "CASE WHEN (i * 3 + j * 5 + tau + run) % 7 < 3 THEN '-->' WHEN (i + run) % 3 = 0 THEN 'o-o' ELSE '' END AS link")
    return L.summary(runs, 0.9).select("i", "j", "tau", "link", "frequency", *[r6(c).alias(c) for c in ("mean", "low", "high")])


# -- discovery ----------------------------------------------------------------------------------------


def _found(f, spark) -> DataFrame:
    return f.links(spark).select("i", "j", "tau", "link", r6("val").alias("val"), r6("p").alias("p"))


@query()
def pcmci(spark, d):
    return _found(Discovery(lineitem_days(spark, d)).run_pcmci(3, pc_alpha=0.2, alpha=0.01, fdr=True), spark)


@query()
def pcmci_alpha_grid(spark, d):
    return _found(Discovery(lineitem_days(spark, d)).run_pcmci(2, pc_alpha=None, alpha=0.01), spark)


@query()
def pcmci_plus(spark, d):
    return _found(Discovery(lineitem_days(spark, d)).run_pcmciplus(2, pc_alpha=0.01), spark)


@query()
def pcmci_plus_datasets(spark, d):
    return _found(Discovery(order_weeks(spark, d)).run_pcmciplus(2, pc_alpha=[0.01, 0.05]), spark)


@query()
def pc_plain(spark, d):
    return _found(Discovery(lineitem_days(spark, d)).run_pc(0, pc_alpha=0.01), spark)


_F15 = [(v, -k) for v in range(5) for k in range(3)]


def sql_swept(nodes: list[tuple[int, int]], out: list[tuple[int, int]], source: str) -> str:
    """CTEs that give `swept` (a, b, s): the covariances of nodes after sweeping `out`, one after another, n rows in `many`."""
    name = {n: f"x{n[0]}_{-n[1]}" for n in nodes}
    pairs = [(a, b) for a in nodes for b in nodes]
    covs = ", ".join(f"covar_pop({name[a]}, {name[b]}) AS c{i}" for i, (a, b) in enumerate(pairs))
    rows = " UNION ALL ".join(f"SELECT '{name[a]}' AS a, '{name[b]}' AS b, c{i} AS s FROM cov" for i, (a, b) in enumerate(pairs))
    steps = [f"many AS (SELECT count(*) AS n FROM {source}), cov AS (SELECT {covs} FROM {source}), s0 AS ({rows})"]
    for k, n in enumerate(out):
        p = name[n]
        steps.append(
            f"s{k + 1} AS (SELECT x.a, x.b, CASE WHEN x.a = '{p}' AND x.b = '{p}' THEN -1 / d.s WHEN x.a = '{p}' THEN r.s / d.s WHEN x.b = '{p}' THEN l.s / d.s ELSE x.s - l.s * r.s / d.s END AS s FROM s{k} x JOIN s{k} l ON l.a = x.a AND l.b = '{p}' JOIN s{k} r ON r.a = '{p}' AND r.b = x.b JOIN s{k} d ON d.a = '{p}' AND d.b = '{p}')"
        )
    return ", ".join(steps) + f", swept AS (SELECT * FROM s{len(out)})"


def _marked_sql(tests: str, alpha: str = "0.05") -> str:
    """Links of tests (i, j, tau, r, n, dim): marks and rounded values."""
    return f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(tau AS INTEGER) AS tau, CASE WHEN p <= {alpha} THEN '-->' ELSE '' END AS link, round(r, 6) AS val, round(p, 6) AS p FROM (SELECT i, j, tau, r, {sql_t_p('r', 'n', 'dim')} AS p FROM ({tests}))"


_LAGGED10 = [(v, -k) for v in range(5) for k in (1, 2)]


@query(
    f"WITH {LI_DAY}, e AS ({sql_lags('li_day', _F15, 4)}), {sql_swept(_F15, _LAGGED10, 'e')}, t AS ("
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {-k} AS tau, c.s / sqrt(c.s * c.s - g.s * v.s) AS r, n, 11 AS dim FROM swept c, swept g, swept v, many WHERE c.a = 'x{i}_{-k}' AND c.b = 'x{j}_0' AND g.a = c.a AND g.b = c.a AND v.a = c.b AND v.b = c.b" for i, k in _LAGGED10 for j in range(5))
    + f") {_marked_sql('SELECT * FROM t')}"
)
def full_conditioning(spark, d):
    """Each lagged link given the whole rest of the past."""
    return _found(Discovery(lineitem_days(spark, d)).momentary(2, 1, kind="fullci"), spark).where("tau > 0")


def _own_past(table: str) -> str:
    tests = []
    for i, k in _LAGGED10:
        for j in range(5):
            z = [f"x{j}_{s}" for s in (1, 2) if (j, -s) != (i, k)]
            tests.append(f"SELECT {i} AS i, {j} AS j, {-k} AS tau, {sql_pcor(lambda a, b: f'corr({a}, {b})', f'x{i}_{-k}', f'x{j}_0', z)} AS r, count(*) AS n, {2 + len(z)} AS dim FROM {table}")
    return " UNION ALL ".join(tests)


@query(f"WITH {LI_DAY}, e AS ({sql_lags('li_day', _F15, 4)}), t AS ({_own_past('e')}) {_marked_sql('SELECT * FROM t')}")
def own_past_conditioning(spark, d):
    return _found(Discovery(lineitem_days(spark, d)).momentary(2, 1, kind="bivci"), spark).where("tau > 0")


_GIVEN = {0: [(0, -1)], 1: [(1, -1)], 2: [(0, -1)], 3: [], 4: [(4, -1)]}


def _momentary_sql(table: str) -> str:
    tests = []
    for i, k in _LAGGED10:
        for j in range(5):
            z = [n for n in _GIVEN[j] if n != (i, k)] + [(v, k + s) for v, s in _GIVEN[i]]
            z = [f"x{v}_{-s}" for v, s in dict.fromkeys(z) if (v, s) not in ((i, k), (j, 0))]
            tests.append(f"SELECT {i} AS i, {j} AS j, {-k} AS tau, {sql_pcor(lambda a, b: f'corr({a}, {b})', f'x{i}_{-k}', f'x{j}_0', z)} AS r, count(*) AS n, {2 + len(z)} AS dim FROM {table}")
    return " UNION ALL ".join(tests)


_F20 = [(v, -k) for v in range(5) for k in range(4)]


@query(f"WITH {LI_DAY}, e AS ({sql_lags('li_day', _F20, 4)}), t AS ({_momentary_sql('e')}) {_marked_sql('SELECT * FROM t', '0.01')}")
def momentary_given_parents(spark, d):
    """Momentary tests of all lagged links, given the parents of both ends."""
    return _found(Discovery(lineitem_days(spark, d)).momentary(2, 1, parents=_GIVEN, alpha=0.01), spark).where("tau > 0")


@query()
def lpcmci(spark, d):
    """Lineitem days with the possibility of hidden common causes."""
    return _found(LatentDiscovery(lineitem_days(spark, d)).run_lpcmci(2, pc_alpha=0.01), spark)


@query()
def jpcmci_plus(spark, d):
    """Segments' order weeks, with a dummy for the segment and one for the week."""
    return _found(JointDiscovery(order_weeks(spark, d), {3: "time_dummy", 4: "space_dummy"}).run_jpcmciplus(1, pc_alpha=0.01), spark)


@query(
    f"""WITH {ORD_SEG}, e AS (SELECT dataset, t, lag(v0, 1) OVER (PARTITION BY dataset ORDER BY t) AS x, v1 AS y, lag(v2, 1) OVER (PARTITION BY dataset ORDER BY t) AS z FROM ord_seg),
    f AS (SELECT dataset, x - avg(x) OVER (PARTITION BY dataset) AS x, y - avg(y) OVER (PARTITION BY dataset) AS y, z - avg(z) OVER (PARTITION BY dataset) AS z FROM e WHERE t >= 2),
    c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n, 3 + count(DISTINCT dataset) AS dim FROM f), r AS (SELECT (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r, n, dim FROM c)
    SELECT round(r, 6) AS val, round({sql_t_p('r', 'n', 'dim')}, 6) AS p FROM r"""
)
def correlation_given_dataset(spark, d):
    """Partial correlation given a variable and the dataset's dummy."""
    found = JointDiscovery(order_weeks(spark, d), {3: "space_dummy"})
    found.at(1)
    a = found.answer(Question(((0, -1),), ((1, 0),), ((2, -1), (3, 0))))
    return spark.createDataFrame([(a.val, a.p)], "val double, p double").select(r6("val").alias("val"), r6("p").alias("p"))


@query(
    f"""WITH {ORD_SEG}, e AS (SELECT dataset, t, v1 AS y FROM ord_seg WHERE t >= 2), k AS (SELECT DISTINCT dataset AS k FROM e),
    c AS (SELECT k, corr(CASE WHEN dataset = k THEN 1.0 ELSE 0.0 END, y) AS r, count(*) AS n FROM e, k GROUP BY k), m AS (SELECT count(*) AS m FROM k), top AS (SELECT r, n, m FROM c, m ORDER BY abs(r) DESC LIMIT 1)
    SELECT round(abs(r), 6) AS size, round(least(1.0, m * {sql_t_p('r', 'n', '1 + m')}), 6) AS p FROM top"""
)
def dataset_dummy_test(spark, d):
    """The dataset's dummy against the price: the largest correlation of an indicator, Bonferroni over them."""
    found = JointDiscovery(order_weeks(spark, d), {3: "space_dummy"})
    found.at(1)
    a = found.answer(Question(((3, 0),), ((1, 0),), ()))
    return spark.createDataFrame([(abs(a.val), a.p)], "size double, p double").select(r6("size").alias("size"), r6("p").alias("p"))


@query()
def regimes(spark, d):
    """Two regimes of the first three lineitem series."""
    p = lineitem_days(spark, d)
    found = RegimeDiscovery(Panel(p.df.select("dataset", "t", "v0", "v2", "v3").toDF("dataset", "t", "v0", "v1", "v2"), ["quantity", "flag_A", "flag_N"])).run_rpcmci(2, 3, annealings=2, iterations=4)
    return found.times.groupBy("regime").agg(F.count(F.lit(1)).alias("times"))


@query(
    f"""WITH {LI_DAY}, n AS (SELECT max(t) + 1 AS n FROM li_day), e AS (SELECT t, lag(v2, 1) OVER (ORDER BY t) AS x, v3 AS y FROM li_day),
    w AS (SELECT CAST(s AS BIGINT) AS run FROM range(0, 100) r(s), n WHERE s * 400 < n - 500)
    SELECT run, count(*) AS n, round(corr(x, y), 6) AS r FROM w JOIN e ON e.t >= run * 400 AND e.t < run * 400 + 500 AND e.t >= 2 GROUP BY run"""
)
def sliding_window_correlation(spark, d):
    df = windowed(lagged(lineitem_days(spark, d), [(2, -1), (3, 0)], 2), "shared", 400, 500)
    return df.groupBy("run").agg(F.count(F.lit(1)).alias("n"), r6(F.corr(column((2, -1)), column((3, 0)))).alias("r"))


@query()
def sliding_windows(spark, d):
    found = Discovery(lineitem_days(spark, d))
    runs = found.windows("run_pcmci", 800, 800, tau_max=1, alpha=0.01)
    return found.summarised(runs).select("i", "j", "tau", "link", r6("frequency").alias("frequency"), r6("mean").alias("mean"))


@query()
def bootstrap_summary(spark, d):
    found = Discovery(lineitem_days(spark, d))
    runs = found.bootstrap("run_pcmci", tau_max=1, samples=20, block=5, seed=1)
    return found.summarised(runs).select("i", "j", "tau", "link", r6("frequency").alias("frequency"), r6("mean").alias("mean"))


# -- models and effects ---------------------------------------------------------------------------------

_PARENTS = {0: [(0, -1)], 1: [(0, 0), (1, -1)], 2: [(0, 0)], 3: [(0, 0)], 4: [(2, 0)]}


@query(
    f"""WITH {LI_DAY}, e AS (SELECT t, v0, v1, v2, v4, lag(v0, 1) OVER (ORDER BY t) AS l0 FROM li_day), f AS (SELECT * FROM e WHERE t >= 1)
    SELECT CAST(0 AS INTEGER) AS j, CAST(0 AS INTEGER) AS i, CAST(-1 AS INTEGER) AS lag, round(regr_slope(v0, l0), 6) AS coef FROM f UNION ALL SELECT 4, 2, 0, round(regr_slope(v4, v2), 6) FROM f"""
)
def link_coefficients(spark, d):
    m = LinearModel.fit(lineitem_days(spark, d), {0: [(0, -1)], 4: [(2, 0)]}, 1)
    return spark.createDataFrame([(j, i, lag, float(c)) for j in (0, 4) for (i, lag), c in zip(m.parents[j], m.coef[j])], "j int, i int, lag int, coef double").withColumn("coef", r6("coef"))


@query(
    f"""WITH {LI_DAY}, e AS (SELECT t, v0, lag(v0, 1) OVER (ORDER BY t) AS l0 FROM li_day), f AS (SELECT regr_slope(v0, l0) AS a, regr_intercept(v0, l0) AS b FROM e WHERE t BETWEEN 1 AND 999)
    SELECT t, v0 AS actual, round(a * l0 + b, 4) AS predicted FROM e, f WHERE t >= 1000"""
)
def forecast(spark, d):
    p = Prediction(lineitem_days(spark, d), F.col("t") < 1000, F.col("t") >= 1000)
    p.fit(0, [(0, -1)], 1)
    return p.predict().select("t", "actual", F.round("predicted", 4).alias("predicted"))


@query()
def forecast_predictors(spark, d):
    p = Prediction(lineitem_days(spark, d), F.col("t") < 1000, F.col("t") >= 1000)
    return spark.createDataFrame([(i, lag) for i, lag in p.predictors(0, 2, 4)] or [], "i int, lag int")


def _two(y: str, a: str, b: str) -> tuple[str, str]:
    """Least-squares coefficients of y on a and b."""
    c = lambda p, q: f"covar_pop({p}, {q})"
    det = f"({c(a, a)} * {c(b, b)} - {c(a, b)} * {c(a, b)})"
    return f"(({c(a, y)} * {c(b, b)} - {c(b, y)} * {c(a, b)}) / {det})", f"(({c(b, y)} * {c(a, a)} - {c(a, y)} * {c(a, b)}) / {det})"


_E = f"e AS ({sql_lags('li_day', [(0, 0), (0, -1), (1, 0), (1, -1), (2, 0), (3, 0), (4, 0)], 2)})"
_SD = lambda c: f"stddev_pop({c})"
_LINKS5 = f"""coef AS (SELECT corr(x0_0, x0_1) AS c00, {_two('x1_0', 'x0_0', 'x1_1')[0]} * {_SD('x0_0')} / {_SD('x1_0')} AS c01, {_two('x1_0', 'x0_0', 'x1_1')[1]} * {_SD('x1_1')} / {_SD('x1_0')} AS c11, corr(x0_0, x2_0) AS c02, corr(x0_0, x3_0) AS c03, corr(x2_0, x4_0) AS c24 FROM e),
    link AS (SELECT 0 AS i, 0 AS j, 1 AS lag, c00 AS w FROM coef UNION ALL SELECT 0, 1, 0, c01 FROM coef UNION ALL SELECT 1, 1, 1, c11 FROM coef UNION ALL SELECT 0, 2, 0, c02 FROM coef UNION ALL SELECT 0, 3, 0, c03 FROM coef UNION ALL SELECT 2, 4, 0, c24 FROM coef),
    walk(i, j, lag, w, no) AS (SELECT i.range, i.range, 0, 1.0::DOUBLE, k.range - 1 FROM range(5) i, range(6) k UNION ALL SELECT walk.i, link.j, walk.lag + link.lag, walk.w * link.w, walk.no FROM walk JOIN link ON link.i = walk.j AND walk.lag + link.lag <= 2 AND link.j <> walk.no),
    psi AS (SELECT i, j, lag, no, sum(w) AS w FROM walk GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {LI_DAY}, {_E}, {_LINKS5}, most AS (SELECT i, j, max(abs(w)) AS w FROM psi WHERE no = -1 GROUP BY ALL),
    pair AS (SELECT a.range AS i, b.range AS j FROM range(5) a, range(5) b WHERE a.range <> b.range), full_ AS (SELECT pair.i, pair.j, coalesce(w, 0.0) AS w FROM pair LEFT JOIN most USING (i, j)),
    lost AS (SELECT a.i, a.j, k.range AS k, max(abs(a.w - coalesce(b.w, 0.0))) AS w FROM psi a CROSS JOIN range(5) k LEFT JOIN psi b ON b.i = a.i AND b.j = a.j AND b.lag = a.lag AND b.no = k.range WHERE a.no = -1 GROUP BY ALL),
    out AS (
      SELECT 'effect 0-4' AS name, (SELECT w FROM psi WHERE i = 0 AND j = 4 AND lag = 0 AND no = -1) AS val
      UNION ALL SELECT 'through 2', (SELECT w FROM psi WHERE i = 0 AND j = 4 AND lag = 0 AND no = -1) - coalesce((SELECT w FROM psi WHERE i = 0 AND j = 4 AND lag = 0 AND no = 2), 0.0)
      UNION ALL SELECT 'joint', coalesce((SELECT w FROM psi WHERE i = 0 AND j = 4 AND lag = 0 AND no = 1), 0.0) + coalesce((SELECT w FROM psi WHERE i = 1 AND j = 4 AND lag = 0 AND no = 0), 0.0)
      UNION ALL SELECT 'ace ' || i, avg(w) FROM full_ GROUP BY i UNION ALL SELECT 'acs ' || j, avg(w) FROM full_ GROUP BY j
      UNION ALL SELECT 'amce ' || k.range, avg(coalesce(lost.w, 0.0)) FROM pair CROSS JOIN range(5) k LEFT JOIN lost ON lost.i = pair.i AND lost.j = pair.j AND lost.k = k.range WHERE pair.i <> k.range AND pair.j <> k.range GROUP BY k.range)
    SELECT name, round(val, 6) AS val FROM out"""
)
def mediation(spark, d):
    m = Mediation.fit(lineitem_days(spark, d), _PARENTS, 2)
    rows = [("effect 0-4", m.effect(0, 0, 4)), ("through 2", m.mediated(0, 0, 4, 2)), ("joint", m.joint([(0, 0), (1, 0)], 4))]
    rows += [(f"{n} {j}", f(j)) for n, f in (("ace", m.average_effect), ("acs", m.average_susceptibility), ("amce", m.average_mediated)) for j in range(5)]
    return spark.createDataFrame(rows, "name string, val double").withColumn("val", r6("val"))


@query()
def mediation_interval(spark, d):
    low, high = bootstrap_effects(lineitem_days(spark, d), _PARENTS, 1, lambda m: m.effect(0, 0, 4), samples=50, block=5)
    return spark.createDataFrame([(low, high)], "low double, high double").select(r6("low").alias("low"), r6("high").alias("high"))


@query(
    f"""WITH {LI_DAY}, e AS (SELECT t, v0, lag(v0, 1) OVER (ORDER BY t) AS l0, v2 FROM li_day)
    SELECT round(regr_slope(v2, l0), 6) AS effect FROM e WHERE t >= 1"""
)
def total_effect(spark, d):
    """Of the quantity one day earlier on returned lines, in a graph where it acts through the quantity."""
    g = from_links({0: [(0, -1)], 1: [(0, 0)], 2: [(0, 0)], 3: [], 4: []})
    e = CausalEffects(g, [(0, -1)], [(2, 0)]).fit(lineitem_days(spark, d), adjust=[])
    return spark.createDataFrame([(float(next(iter(e.effect().values()))),)], "effect double").withColumn("effect", r6("effect"))


@query(
    f"""WITH {LI_DAY}, e AS ({sql_lags('li_day', [(0, 0), (1, -1), (2, 0)], 1)}), m AS (SELECT {_two('x2_0', 'x0_0', 'x1_1')[0]} AS b, avg(x2_0) AS y, avg(x0_0) AS x FROM e)
    SELECT CAST(k AS INTEGER) AS "case", round(y + b * (do_x - x), 6) AS y0 FROM m, (VALUES (0, 0.0), (1, 100.0), (2, 700.0)) c(k, do_x)"""
)
def intervention(spark, d):
    p = lineitem_days(spark, d)
    e = CausalEffects(from_links({0: [(0, -1)], 1: [(0, 0), (1, -1)], 2: [(0, 0), (1, 0)], 3: [], 4: []}), [(0, 0)], [(2, 0)]).fit(p)
    return e.predict(p, [[0.0], [100.0], [700.0]]).select("case", r6("y0").alias("y0"))


@query(
    f"""WITH {LI_DAY}, m AS (SELECT {_two('v2', 'v0', 'v1')[0]} AS b0, {_two('v2', 'v0', 'v1')[1]} AS b1, regr_slope(v1, v0) AS a FROM li_day)
    SELECT 'all' AS paths, round(b0 + a * b1, 6) AS effect FROM m UNION ALL SELECT 'through 1', round(a * b1, 6) FROM m"""
)
def path_effects(spark, d):
    p = lineitem_days(spark, d)
    e = CausalEffects(from_links({0: [(0, -1)], 1: [(0, 0)], 2: [(0, 0), (1, 0)], 3: [], 4: []}), [(0, 0)], [(2, 0)])
    rows = [("all", *e.wright(p).values()), ("through 1", *e.wright(p, through=[(1, 0)]).values())]
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "paths string, effect double").withColumn("effect", r6("effect"))


@query(
    f"""WITH {LI_DAY}, e AS ({sql_lags('li_day', [(0, 0), (0, -1), (1, 0), (1, -1), (2, 0), (3, 0), (4, 0)], 1)}),
    m AS (SELECT regr_slope(x0_0, x0_1) AS a, {_two('x1_0', 'x0_0', 'x1_1')[0]} AS b0, {_two('x1_0', 'x0_0', 'x1_1')[1]} AS b1, regr_slope(x2_0, x0_0) AS c, regr_slope(x3_0, x0_0) AS f, regr_slope(x4_0, x2_0) AS g FROM e),
    r AS (SELECT x0_0 - a * x0_1 AS r0, x1_0 - b0 * x0_0 - b1 * x1_1 AS r1, x2_0 - c * x0_0 AS r2, x3_0 - f * x0_0 AS r3, x4_0 - g * x2_0 AS r4 FROM e, m) """
    + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round(covar_samp(r{i}, r{j}), 3) AS cov FROM r" for i in range(5) for j in range(5))
)
def residual_covariance(spark, d):
    p = lineitem_days(spark, d)
    c = LinearModel.fit(p, _PARENTS, 1).residual_covariance(p)
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(5) for j in range(5)], "i int, j int, cov double").withColumn("cov", F.round("cov", 3))


@query()
def simulated_ensemble(spark, d):
    return ensemble(spark, random_links(4, 4, 2, seed=3), 100, 8, seed=1).groupBy("dataset").agg(*[r6(F.avg(f"v{i}")).alias(f"v{i}") for i in range(4)])


def _graph_with_mediator() -> np.ndarray:
    """Quantity acts on returned lines directly and through the revenue, which keeps its own past."""
    return from_links({0: [(0, -1)], 1: [(0, 0), (1, -1)], 2: [(0, 0), (1, 0)], 3: [], 4: []})


@query(ORACLES["intervention"])
def general_total_effect(spark, d):
    """The same intervention by an estimator that is fitted on arrays, its predictions averaged over the cluster."""
    e = GeneralEffects(_graph_with_mediator(), [(0, 0)], [(2, 0)], estimator=LeastSquares, transform=Standardised).fit(lineitem_days(spark, d))
    return e.predict([[0.0], [100.0], [700.0]]).select("case", r6("y0").alias("y0"))


@query(f"WITH {LI_DAY}, m AS (SELECT {_two('v2', 'v0', 'v3')[0]} AS b, {_two('v2', 'v0', 'v3')[1]} AS c, avg(v2) AS y, avg(v0) AS x, avg(v3) AS s FROM li_day) SELECT round(y + b * (100.0 - x) + c * (50.0 - s), 6) AS y0 FROM m")
def conditional_total_effect(spark, d):
    """Given the number of lines not returned."""
    g = from_links({0: [], 1: [], 2: [(0, 0), (3, 0)], 3: [], 4: []}, 1)
    e = GeneralEffects(g, [(0, 0)], [(2, 0)], s=[(3, 0)], estimator=LeastSquares).fit(lineitem_days(spark, d), tau_max=0)
    return e.predict([[100.0]], given=[[50.0]]).select(r6("y0").alias("y0"))


@query(
    f"""WITH {LI_DAY}, e AS ({sql_lags('li_day', [(0, 0), (1, 0), (2, 0)], 0)}), m AS (SELECT {_two('x2_0', 'x0_0', 'x1_0')[0]} AS b, {_two('x2_0', 'x0_0', 'x1_0')[1]} AS c, regr_slope(x1_0, x0_0) AS a FROM e)
    SELECT round(10 * b, 6) AS direct, round(10 * a * c, 6) AS indirect FROM m"""
)
def natural_effects_linear(spark, d):
    """Direct and indirect effects through the revenue; with least squares these are products of coefficients."""
    e = natural_effects(lineitem_days(spark, d), from_links({0: [], 1: [(0, 0)], 2: [(0, 0), (1, 0)], 3: [], 4: []}), (0, 0), (2, 0), LeastSquares)
    return spark.createDataFrame([(e.direct(0.0, 10.0), e.indirect(0.0, 10.0))], "direct double, indirect double").select(r6("direct").alias("direct"), r6("indirect").alias("indirect"))


@query()
def natural_effects_neighbours(spark, d):
    """The same by nearest neighbours, smoothed over the quantity."""
    p = lineitem_days(spark, d)
    e = natural_effects(p, from_links({0: [], 1: [(0, 0)], 2: [(0, 0), (1, 0)], 3: [], 4: []}), (0, 0), (2, 0), lambda: Standardised(Nearest(20)))
    at, effect = e.smoothed(200.0, 800.0, 50.0, steps=12, sigma=2)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(at, effect)], "x double, effect double").select("x", r6("effect").alias("effect"))


@query("SELECT 'direct' AS name, 3.0::DOUBLE AS val UNION ALL SELECT 'indirect', 2.0 UNION ALL SELECT 'series', 1.5")
def counterfactual_truth(spark, d):
    """In linear worlds that share their noise the effects are exact: 1.5 * 2, 0.5 * 2 * 2, and through one lag 0.75 * 2."""
    m = CounterfactualModel({"x": lambda v: v.noise, "m": lambda v: 0.5 * v["x"] + v.noise, "y": lambda v: 1.5 * v["x"] + 2.0 * v["m"] + v.noise})
    s = CounterfactualModel({"x": lambda v: v.noise, "y": lambda v: 0.75 * v["x", -1] + 0.5 * v["y", -1] + v.noise}, steps=2)
    rows = [("direct", natural_direct_effect(m, spark, "x", "y", ["m"], 1.0, 3.0, 2000)), ("indirect", natural_indirect_effect(m, spark, "x", "y", ["m"], 1.0, 3.0, 2000)), ("series", natural_direct_effect(s, spark, "x", "y", [], 0.0, 2.0, 2000))]
    return spark.createDataFrame(rows, "name string, val double").withColumn("val", F.round("val", 6))


@query("SELECT CAST(4 AS BIGINT) AS datasets, CAST(60 AS BIGINT) AS times, true AS time_shared, true AS space_constant")
def context_datasets(spark, d):
    """What makes context context: the time context is the same in all datasets, the space context at all times."""
    links = {0: [((0, -1), 0.5, None), ((2, 0), 1.0, None), ((3, 0), 1.0, None)], 1: [((0, -1), 0.5, None)], 2: [((2, -1), 0.5, None)], 3: []}
    df = context_model(spark, links, {2: "time_context", 3: "space_context"}, 4, 60, seed=5).persist()
    shared = df.groupBy("t").agg(F.countDistinct("v2").alias("k")).agg((F.max("k") == 1).alias("a")).first()["a"]
    still = df.groupBy("dataset").agg(F.countDistinct("v3").alias("k")).agg((F.max("k") == 1).alias("a")).first()["a"]
    n = df.agg(F.countDistinct("dataset"), F.countDistinct("t")).first()
    df.unpersist()
    return spark.createDataFrame([(n[0], n[1], shared, still)], "datasets long, times long, time_shared boolean, space_constant boolean")


@query(
    """SELECT name, val FROM (VALUES ('amenable: v into x', true), ('amenable: alone', false), ('optimal: confounded', true), ('visible in models', true), ('one hidden variable', true), ('relevant lag', true), ('directed member', true)) t(name, val)"""
)
def graph_facts(spark, d):
    """Facts of small graphs that can be told by hand."""
    seen = TimeGraph(_marks({(0, 1): "-->", (2, 0): "-->"}, 3), 0)
    alone = TimeGraph(_marks({(0, 1): "-->"}, 2), 0)
    confounded = Adjustment(_marks({(0, 1): "-->", (2, 0): "-->", (2, 1): "-->"}, 3), [(0, 0)], [(1, 0)], horizon=0)
    member = directed_member(_marks({(0, 1): "o-o", (1, 2): "o-o", (0, 2): "o-o"}, 3), [0, 1, 2])[:, :, 0]
    rows = [
        ("amenable: v into x", seen.amenable([(0, 0)], [(1, 0)])),
        ("amenable: alone", alone.amenable([(0, 0)], [(1, 0)])),
        ("optimal: confounded", confounded.optimality() and confounded.optimal() == {(2, 0)}),
        ("visible in models", alone.amenable([(0, 0)], [(1, 0)], latent=False)),
        ("one hidden variable", canonical(_marks({(0, 1): "<->"}, 2)) == {0: [(2, 0)], 1: [(2, 0)], 2: []}),
        ("relevant lag", relevant_lag(from_links({0: [(0, -1)], 1: [(0, -2)]}), [(1, 0)]) == 3),
        ("directed member", sorted((member == "-->").sum(0).tolist()) == [0, 1, 2]),
    ]
    return spark.createDataFrame([(n, bool(v)) for n, v in rows], "name string, val boolean")


def _marks(links: dict[tuple[int, int], str], n: int) -> np.ndarray:
    graph = np.full((n, n, 1), "", dtype="<U3")
    for (i, j), mark in links.items():
        graph[i, j, 0], graph[j, i, 0] = mark, reverse(mark)
    return graph


@query(
    f"""WITH {LI_DAY} """
    + " UNION ALL ".join(f"SELECT '{n}' AS variable, count(v{i}) AS n, count(*) - count(v{i}) AS missing, round(avg(v{i}), 4) AS mean, round(stddev_pop(v{i}), 4) AS std, round(min(v{i}), 4) AS low, round(max(v{i}), 4) AS high FROM li_day" for i, n in enumerate(("quantity", "revenue", "flag_A", "flag_N", "flag_R")))
)
def panel_summary(spark, d):
    return described(lineitem_days(spark, d)).select("variable", "n", "missing", *[F.round(c, 4).alias(c) for c in ("mean", "std", "low", "high")])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Causal links between daily line-item series."""
    return pcmci(spark, d)
