"""Queries of gaze recordings, and of lookups and guards that stand beside them. Events stand for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import calculus, features, fusion, gaze, physiology, windows
from .series import FEW, FIVE, ORDER, TIME_WINDOWS, framed_events
from .tables import DAY, EVENTS, events, rounded, table

Q = {}
SQL = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def gaze_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values at half the rate."""
    return rounded(gaze.resampled(framed_events(spark, sf_dir), ["user_id"], ["value"], 1, 2, FEW), "value")


_TAPS = [float(v) for v in gaze.low_pass_taps(1, 2)]
SQL["gaze_resampled"] = f"""WITH {EVENTS}, f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
o AS (SELECT user_id, unnest(range((any_value(n) + 1) // 2)) AS frame FROM f GROUP BY user_id)
SELECT o.user_id, o.frame, round(sum(value * {_TAPS}[(2 * frame - i + {len(_TAPS) // 2 + 1})::INT]), 6) AS value FROM o JOIN f ON f.user_id = o.user_id AND i BETWEEN 2 * frame - {len(_TAPS) // 2} AND 2 * frame + {len(_TAPS) // 2} GROUP BY 1, 2"""


@query
def fixations_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells in which a user's value stays near where it was, over the whole recording in blocks; the tests hold it against the plain fold."""
    return gaze.fixations(framed_events(spark, sf_dir).withColumn("zero", F.lit(0.0)), ["user_id"], "t", "value", "zero", radius=25.0, least=3600.0, size=FEW)


@query
def eye_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 13 metrics of two-day windows of which at most a quarter is missing. Clicks are fixations, purchases blinks, errors lost samples."""
    e = events(spark, sf_dir)
    lost = F.col("event_type") == "error"
    samples = e.select("user_id", "t", lost.alias("lost"), F.when(~lost, F.col("value")).alias("x"), F.when(~lost, (F.col("event_id") * 7 % 100).cast("double")).alias("y"))
    spans = lambda kind, length: e.where(F.col("event_type") == kind).select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * length).alias("end"))
    found = gaze.window_metrics(samples, spans("click", 2.0), spans("purchase", 1.0), ["user_id"], "t", "x", "y", "lost", 2 * DAY, DAY, 0.01)
    daily = found.withColumns({c: F.col(c) * DAY for c in ("mean_vel", "max_vel", "fix_rate", "blink_rate", "sac_rate")}).withColumn("mean_acc", F.col("mean_acc") * DAY * DAY)
    return rounded(daily, *[c for c in daily.columns if c not in ("user_id", "window_index", "fix_count", "blink_count", "sac_count")], places=4)


def _inside(kind: str, name: str, length: float) -> str:
    return f"{name} AS (SELECT k.user_id, k.window_index, count(*) AS n, avg(e.t + e.value * {length} - e.t) AS d FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = '{kind}' AND e.t BETWEEN start_time AND end_time GROUP BY 1, 2)"


SQL["eye_window_metrics"] = f"""WITH {TIME_WINDOWS}, s AS (SELECT user_id, window_index, t, event_type = 'error' AS lost, CASE WHEN event_type <> 'error' THEN value END AS x, CASE WHEN event_type <> 'error' THEN (event_id * 7 % 100)::DOUBLE END AS y FROM w),
v AS (SELECT *, t - lag(t) OVER p AS dt, sqrt((x - lag(x) OVER p) ** 2 + (y - lag(y) OVER p) ** 2) / nullif(t - lag(t) OVER p, 0) AS v FROM s WINDOW p AS (PARTITION BY user_id, window_index ORDER BY t)),
a AS (SELECT *, (v - lag(v) OVER p) / nullif(dt, 0) AS a, coalesce(v > 0.01, false) AS fast FROM v WINDOW p AS (PARTITION BY user_id, window_index ORDER BY t)),
b AS (SELECT *, fast AND NOT coalesce(lag(fast) OVER p, false) AS new FROM a WINDOW p AS (PARTITION BY user_id, window_index ORDER BY t)),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id, window_index ORDER BY t) AS run FROM b),
k AS (SELECT user_id, window_index, min(t) AS start_time, max(t) AS end_time, 100 * avg(lost::INT) AS pct_missing, avg(v) AS mean_vel, max(v) AS max_vel, avg(a) AS mean_acc, sqrt(var_pop(x) + var_pop(y)) AS rms_disp FROM r GROUP BY 1, 2 HAVING 100 * avg(lost::INT) <= 25),
sa AS (SELECT user_id, window_index, count(*) AS n, avg(d) AS d FROM (SELECT user_id, window_index, run, max(t) - min(t) AS d FROM r WHERE fast GROUP BY ALL) GROUP BY 1, 2),
{_inside("click", "fi", 2.0)}, {_inside("purchase", "bl", 1.0)}
SELECT k.user_id, k.window_index, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time, round(pct_missing, 4) AS pct_missing, round(mean_vel * {DAY}, 4) AS mean_vel, round(max_vel * {DAY}, 4) AS max_vel, round(mean_acc * {DAY} * {DAY}, 4) AS mean_acc, round(rms_disp, 4) AS rms_disp,
 {", ".join(f"coalesce({t}.n, 0) AS {c}_count, round({t}.d, 4) AS {c}_mean_dur, round(coalesce({t}.n, 0) / nullif(end_time - start_time, 0) * {DAY}, 4) AS {c}_rate" for c, t in (("fix", "fi"), ("blink", "bl"), ("sac", "sa")))}
FROM k LEFT JOIN fi USING (user_id, window_index) LEFT JOIN bl USING (user_id, window_index) LEFT JOIN sa USING (user_id, window_index)"""


@query
def eda_full_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skin-conductance features of windows that hold at least nine tenths of six samples."""
    e = events(spark, sf_dir).withColumn("tonic", calculus.rolling_median("value", ["user_id"], ORDER)).withColumn("peak", F.col("event_type") == "purchase")
    dealt = windows.by_time(e, ["user_id"], "t", 2 * DAY, DAY)
    found = physiology.eda(dealt, ["user_id", "window_index"], ORDER, "peak", "value", "tonic", "value", size=6)
    return rounded(found.select("user_id", "window_index", "n", "scr_peaks_n", "eda_tonic_sd"), "eda_tonic_sd")


SQL["eda_full_windows"] = f"""WITH {TIME_WINDOWS.replace("max(t) OVER (PARTITION BY user_id) AS last FROM e", f"max(t) OVER (PARTITION BY user_id) AS last, quantile_cont(value, 0.5) OVER {FIVE} AS tonic FROM e")}
SELECT user_id, window_index, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS scr_peaks_n, round(stddev_samp(tonic), 6) AS eda_tonic_sd FROM w GROUP BY ALL HAVING count(*) >= 6 * 0.9"""


@query
def eda_high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values cleaned and split by filters of both kinds; the tests hold these against plain ones."""
    clean = physiology.eda_cleaned(events(spark, sf_dir), "user_id", ORDER, "value", rate=20.0)
    return physiology.eda_high_pass(clean.select("user_id", *ORDER, F.col("value_clean").alias("clean")), "user_id", ORDER, "clean", rate=20.0)


@query
def session_order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of sessions and their numbers in studies of two orders and of six; customers stand for participants."""
    code = lambda k: F.element_at(F.array(*[F.lit(c) for c in ("Low", "Medium", "High")]), (F.floor(F.col("c_custkey") / k) % 3 + 1).cast("int"))
    info = table(spark, sf_dir, "customer").select("c_custkey", code(1).alias("session01"), code(3).alias("session02"), F.when(F.col("c_custkey") % 11 > 0, code(9)).alias("session03"))
    names = ["session01", "session02", "session03"]
    two = fusion.session_order(info, "c_custkey", names, fusion.TWO_ORDERS).withColumnRenamed("session_order_numeric", "of_two")
    six = fusion.session_order(info, "c_custkey", names, fusion.SIX_ORDERS).select("participant", F.col("session_order_numeric").alias("of_six"))
    return two.join(six, "participant")


_CODE = "['L', 'M', 'H'][c_custkey // {k} % 3 + 1]"
SQL["session_order_numbers"] = f"""WITH o AS (SELECT c_custkey AS participant, {_CODE.format(k=1)} || {_CODE.format(k=3)} || CASE WHEN c_custkey % 11 > 0 THEN {_CODE.format(k=9)} END AS session_order FROM customer)
SELECT participant, session_order, CASE session_order {" ".join(f"WHEN '{o}' THEN {n}" for o, n in fusion.TWO_ORDERS.items())} END::INT AS of_two, CASE session_order {" ".join(f"WHEN '{o}' THEN {n}" for o, n in fusion.SIX_ORDERS.items())} END::INT AS of_six FROM o"""


@query
def screen_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in pixels as shares of the screen."""
    x, y = geometry.to_screen((F.col("value") * 25.0, F.col("t") % 1440), 2560, 1440)
    return rounded(events(spark, sf_dir).select("event_id", x.alias("x"), y.alias("y")), "x", "y")


SQL["screen_normalised"] = f"WITH {EVENTS} SELECT event_id, round(value * 25.0 / 2560, 6) AS x, round((t % 1440) / 1440, 6) AS y FROM e"


@query
def candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the metrics of a window table, first ones first, and which of them is shown by default."""
    stats = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("window_index")).agg(F.avg("value").alias("x_mean"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("mouth_aperture_rms"), F.max("value").alias("x_mean_abs_vel"), F.first("event_type").alias("kind")).withColumnRenamed("user_id", "participant")
    columns = features.metric_columns(stats)
    means = stats.agg(*[F.avg(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("metric"), F.lit(c == features.default_metric(columns)).alias("shown"), F.col(c).alias("mean")) for i, c in enumerate(columns)])
    return rounded(means.select(F.inline(rows)), "mean", places=4)


SQL["candidate_metrics"] = f"""WITH {EVENTS}, s AS (SELECT user_id, floor(t / {DAY}) AS w, avg(value) AS m, sqrt(avg(value * value)) AS r, max(value) AS v FROM e GROUP BY 1, 2), a AS (SELECT avg(m) AS m, avg(r) AS r, avg(v) AS v FROM s)
SELECT unnest([0, 1, 2])::INT AS place, unnest(['mouth_aperture_rms', 'x_mean_abs_vel', 'x_mean']) AS metric, unnest([true, false, false]) AS shown, unnest([round(r, 4), round(v, 4), round(m, 4)]) AS mean FROM a"""


@query
def hops_of_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten items of each supplier for an overlap so large that the hop would be none."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    dealt = windows.by_count(items, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 10, features.hop_of(10, 0.95))
    # windows are complete, so each has one first row, and none need be remembered
    return dealt.groupBy("l_suppkey").agg(F.count_if(F.col("frame") == F.col("window_index") * features.hop_of(10, 0.95)).alias("windows"), F.count("*").alias("rows"))


SQL["hops_of_overlap"] = "SELECT l_suppkey, count(*) - 9 AS windows, (count(*) - 9) * 10 AS rows FROM lineitem GROUP BY 1 HAVING count(*) >= 10"
