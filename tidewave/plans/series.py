"""Queries on series: windows, derivatives, medians, runs, interpolation, masks, physiology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import binocular, clean_features, nullify_below, row_mean
from ..operators import calculus, matching, physiology, signal, slices, windows
from .tables import DAY, EVENTS, events, rounded, table

Q = {}
SQL = {}
ORDER = ["t", "event_id"]
MOMENTS = ["rms", "mean", "std", "median", "p25", "p75", "autocorr1"]


def query(f):
    Q[f.__name__] = f
    return f


STATS_SQL = """count(x) AS n, min(x) AS min, max(x) AS max, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
 round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75,
 round(CASE WHEN isnan(corr(x, prev)) THEN NULL ELSE corr(x, prev) END, 6) AS autocorr1"""


@query
def win_stats_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day windows every day over each user's events."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    return rounded(windows.statistics(dealt, ["user_id", "window_index"], "value", ORDER), *MOMENTS)


TIME_WINDOWS = f"""{EVENTS}, l AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last FROM e),
w AS (SELECT l.*, k::INT AS window_index FROM l, range(0, 1000) g(k) WHERE k * {DAY} <= t AND t < k * {DAY} + {2 * DAY} AND k * {DAY} < last - {2 * DAY} + 1)"""
SQL["win_stats_time"] = f"""WITH {TIME_WINDOWS}, p AS (SELECT *, value AS x, lag(value) OVER (PARTITION BY user_id, window_index ORDER BY t, event_id) AS prev FROM w)
SELECT user_id, window_index, {STATS_SQL} FROM p GROUP BY ALL"""

ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query
def win_stats_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 rows every 32 over each supplier's items; a window with a missing price would have NULLs."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", *ITEM_ORDER)
    dealt = windows.by_count(items, ["l_suppkey"], ITEM_ORDER, 64, 32)
    return rounded(windows.statistics(dealt, ["l_suppkey", "window_index"], "l_extendedprice", ["frame"], minimum=64), *MOMENTS)


SQL["win_stats_count"] = f"""WITH f AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ITEM_ORDER)}) - 1 AS frame, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem),
w AS (SELECT *, unnest(range(greatest(0, ceil((frame - 63) / 32.0))::BIGINT, frame // 32 + 1))::INT AS window_index FROM f),
p AS (SELECT l_suppkey, window_index, l_extendedprice AS x, lag(l_extendedprice) OVER (PARTITION BY l_suppkey, window_index ORDER BY frame) AS prev FROM w WHERE window_index * 32 + 64 <= total)
SELECT l_suppkey, window_index, {STATS_SQL} FROM p GROUP BY ALL"""


@query
def gradient_vel_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculus.derivatives(events(spark, sf_dir), "value", ["user_id"], ORDER)
    return rounded(found.select("user_id", "event_id", "value_vel", "value_acc"), "value_vel", "value_acc")


def _gradient_sql(x: str, source: str, name: str) -> str:
    w = "(PARTITION BY user_id ORDER BY t, event_id)"
    return f"""{name} AS (SELECT *, CASE WHEN row_number() OVER {w} = 1 THEN lead({x}) OVER {w} - {x} WHEN lead(1) OVER {w} IS NULL THEN {x} - lag({x}) OVER {w}
ELSE (lead({x}) OVER {w} - lag({x}) OVER {w}) / 2 END AS {name}x FROM {source})"""


SQL["gradient_vel_acc"] = f"""WITH {EVENTS}, {_gradient_sql("value", "e", "v")}, {_gradient_sql("vx", "v", "a")}
SELECT user_id, event_id, round(vx, 6) + 0.0 AS value_vel, round(ax, 6) + 0.0 AS value_acc FROM a"""


@query
def finite_diff_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change by the hour."""
    e = events(spark, sf_dir).withColumn("hour", F.col("t") / 3600)
    found = calculus.finite_differences(e, "value", "hour", ["user_id"], ORDER)
    return rounded(found.select("user_id", "event_id", "value_vel", "value_acc"), "value_vel", "value_acc", places=4)


SQL["finite_diff_velocity"] = f"""WITH {EVENTS}, v AS (SELECT *, t / 3600 - lag(t / 3600) OVER w AS dt, (value - lag(value) OVER w) / nullif(t / 3600 - lag(t / 3600) OVER w, 0) AS vel FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, round(vel, 4) + 0.0 AS value_vel, round((vel - lag(vel) OVER w) / nullif(dt, 0), 4) + 0.0 AS value_acc FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"""


@query
def rolling_median5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events(spark, sf_dir).select("user_id", "event_id", calculus.rolling_median("value", ["user_id"], ORDER).alias("median5")), "median5")


FIVE = "(PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
SQL["rolling_median5"] = f"WITH {EVENTS} SELECT user_id, event_id, round(quantile_cont(value, 0.5) OVER {FIVE}, 6) AS median5 FROM e"


@query
def median_filter_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculus.clipped_median(events(spark, sf_dir), "value", ["user_id"], ORDER, deviations=2.0)
    return rounded(found.select("user_id", "event_id", "value_clipped"), "value_clipped")


SQL["median_filter_clip"] = f"""WITH {EVENTS}, m AS (SELECT user_id, event_id, list_sort(list_resize(list(value) OVER {FIVE}, 5, 0.0))[3] AS m FROM e),
s AS (SELECT *, avg(m) OVER (PARTITION BY user_id) AS mu, stddev_pop(m) OVER (PARTITION BY user_id) AS sd FROM m)
SELECT user_id, event_id, round(greatest(least(m, mu + 2 * sd), mu - 2 * sd), 6) AS value_clipped FROM s"""


@query
def runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of values over 40, of at least two rows."""
    found = calculus.runs(events(spark, sf_dir), F.col("value") > 40, ["user_id"], ORDER, "t").where("n >= 2")
    return rounded(found.select("user_id", "start", "end", "n", (F.col("end") - F.col("start")).alias("duration")), "start", "end", "duration", places=5)


SQL["runs_islands"] = f"""WITH {EVENTS}, f AS (SELECT *, value > 40 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, value > 40 ORDER BY t, event_id) AS g FROM e)
SELECT user_id, round(min(t), 5) AS start, round(max(t), 5) AS end, count(*) AS n, round(max(t) - min(t), 5) AS duration FROM f WHERE hit GROUP BY user_id, g HAVING count(*) >= 2"""


@query
def blink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs where a signal's z-score is below -0.9, after a centred median of the flag, no longer than two days."""
    whole = Window.partitionBy("user_id")
    e = events(spark, sf_dir)
    z = F.try_divide(F.col("value") - F.avg("value").over(whole), F.stddev_pop("value").over(whole))
    low = e.withColumn("low", F.coalesce((z < -0.9) | (F.col("value") < 2), F.lit(False)).cast("double"))
    smooth = low.withColumn("on", calculus.rolling_median("low", ["user_id"], ORDER) > 0)
    found = calculus.runs(smooth, F.col("on"), ["user_id"], ORDER, "t")
    return rounded(found.where(F.col("end") - F.col("start") <= 2 * DAY).select("user_id", "start", "end", "n"), "start", "end", places=5)


SQL["blink_runs"] = f"""WITH {EVENTS}, z AS (SELECT *, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) < -0.9, false) OR value < 2 AS low FROM e WINDOW w AS (PARTITION BY user_id)),
s AS (SELECT *, quantile_cont(low::INT::DOUBLE, 0.5) OVER {FIVE} > 0 AS lit FROM z),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, lit ORDER BY t, event_id) AS g FROM s)
SELECT user_id, round(min(t), 5) AS start, round(max(t), 5) AS end, count(*) AS n FROM g WHERE lit GROUP BY user_id, g HAVING max(t) - min(t) <= {2 * DAY}"""


@query
def interp_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of error events are missing; gaps of up to two rows are filled."""
    e = events(spark, sf_dir).withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1)
    x = e.withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(calculus.interpolated(x, "x", "frame", ["user_id"], 2).select("user_id", "event_id", "x_filled"), "x_filled")


SQL["interp_limited"] = f"""WITH {EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, CASE WHEN event_type <> 'error' THEN value END AS x FROM e),
n AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS f0, first_value(x IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS f1,
 count(*) OVER (PARTITION BY user_id) AS total FROM f WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN x IS NOT NULL THEN x WHEN coalesce(f1, total) - coalesce(f0, -1) - 1 <= 2 THEN coalesce(v0 + (v1 - v0) * (i - f0) / (f1 - f0), v0, v1) END, 6) AS x_filled FROM n"""


@query
def mask_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices whose confidence (the discount) is below 0.03 are masked; counts and shares by flag."""
    items = table(spark, sf_dir, "lineitem").withColumn("masked", nullify_below(F.col("l_extendedprice"), F.col("l_discount"), 0.03))
    found = items.groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.count("*") - F.count("masked")).alias("n_masked"), F.avg("masked").alias("mean_kept"))
    return rounded(found.withColumn("pct_masked", F.col("n_masked") * F.lit(100.0).cast("double") / F.col("n")), "mean_kept", "pct_masked", places=4)


SQL["mask_by_threshold"] = """SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount < 0.03) AS n_masked, round(avg(l_extendedprice) FILTER (l_discount IS NULL OR l_discount >= 0.03), 4) AS mean_kept,
 round(count(*) FILTER (l_discount < 0.03) * 100.0::DOUBLE / count(*), 4) AS pct_masked FROM lineitem GROUP BY 1"""


@query
def outlier_mask_3sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculus.outliers_to_zero(events(spark, sf_dir), "value", ["user_id"])
    return found.select("user_id", "event_id", "value_masked")


SQL["outlier_mask_3sd"] = """SELECT user_id, event_id, CASE WHEN abs(value - avg(value) OVER w) > 3 * stddev_samp(value) OVER w THEN 0 ELSE value END AS value_masked FROM events WINDOW w AS (PARTITION BY user_id)"""


@query
def bounds_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both coordinates go if either is out of bounds; the limits themselves stay."""
    out = (F.col("l_quantity") > 45) | (F.col("l_extendedprice") < 2000) | (F.col("l_extendedprice") > 90000)
    items = table(spark, sf_dir, "lineitem").withColumns({"x": F.when(~out, F.col("l_quantity")), "y": F.when(~out, F.col("l_extendedprice"))})
    return rounded(items.groupBy("l_suppkey").agg(F.count("x").alias("n_kept"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")), "mean_x", "mean_y", places=4)


SQL["bounds_mask"] = """WITH m AS (SELECT *, l_quantity > 45 OR l_extendedprice < 2000 OR l_extendedprice > 90000 AS gone FROM lineitem)
SELECT l_suppkey, count(*) FILTER (NOT gone) AS n_kept, round(avg(l_quantity) FILTER (NOT gone), 4) AS mean_x, round(avg(l_extendedprice) FILTER (NOT gone), 4) AS mean_y FROM m GROUP BY 1"""


@query
def binocular_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("gaze", binocular(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount"), F.col("l_tax")))
    return rounded(items.groupBy("l_suppkey").agg(F.count("gaze").alias("n"), F.avg("gaze").alias("mean_gaze")), "mean_gaze")


SQL["binocular_combine"] = """WITH g AS (SELECT l_suppkey, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN (l_quantity + l_tax * 100) / 2 WHEN l_discount <> 0 THEN l_quantity WHEN l_tax <> 0 THEN l_tax * 100 END AS gaze FROM lineitem)
SELECT l_suppkey, count(gaze) AS n, round(avg(gaze), 6) AS mean_gaze FROM g GROUP BY 1"""


@query
def clean_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by user that divide by zero in places; missing ones become 0."""
    e = events(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "purchase", "signup")])
    rates = e.select("user_id", F.try_divide(F.col("purchase").cast("double"), F.col("click").cast("double")).alias("per_click"), F.try_divide(F.col("signup").cast("double"), (F.col("click") - F.col("purchase")).cast("double")).alias("per_rest"))
    return rounded(clean_features(rates, ["per_click", "per_rest"]), "per_click", "per_rest")


SQL["clean_feature_table"] = """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1)
SELECT user_id, round(coalesce(p / nullif(c, 0)::DOUBLE, 0), 6) AS per_click, round(coalesce(s / nullif(c - p, 0)::DOUBLE, 0), 6) AS per_rest FROM c"""


@query
def closed_window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates in closed two-day windows every day of 30 days, with windows that hold nothing, and two composites."""
    e = events(spark, sf_dir)
    dealt = windows.in_closed_windows(e, "t", 30 * DAY, 2 * DAY, DAY)
    kind = F.col("event_type")
    rate = lambda k: F.try_divide(F.count_if(kind == k) * F.lit(100.0).cast("double"), F.count("*").cast("double"))
    found = dealt.groupBy("user_id", "window_index").agg(
        F.count("*").alias("n"), rate("error").alias("error_rate"), rate("view").alias("view_rate"),
        F.avg(F.when(kind == "click", F.col("value"))).alias("click_rt"), F.avg(F.when(kind == "purchase", F.col("value"))).alias("purchase_rt"),
    )
    whole = windows.spine(e.select("user_id"), 30 * DAY, 2 * DAY, DAY).join(found, ["user_id", "window_index"], "left")
    out = whole.select("user_id", "window_index", F.coalesce("n", F.lit(0)).alias("n"), "error_rate", "view_rate", (100 - (F.col("error_rate") + F.col("view_rate")) / 2).alias("accuracy"), (row_mean(F.col("click_rt"), F.col("purchase_rt")) / 1000).alias("reaction_time"))
    return rounded(out, "error_rate", "view_rate", "accuracy", "reaction_time", places=9)


SQL["closed_window_rates"] = f"""WITH {EVENTS}, s AS (SELECT DISTINCT user_id, k::INT AS window_index FROM events, range(0, 29) g(k)),
f AS (SELECT user_id, k::INT AS window_index, count(*) AS n, count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) AS error_rate, count(*) FILTER (event_type = 'view') * 100.0::DOUBLE / count(*) AS view_rate,
 avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'purchase') AS p FROM e, range(0, 29) g(k) WHERE t BETWEEN k * {DAY} AND k * {DAY} + {2 * DAY} GROUP BY ALL)
SELECT user_id, window_index, coalesce(n, 0) AS n, round(error_rate, 9) AS error_rate, round(view_rate, 9) AS view_rate, round(100 - (error_rate + view_rate) / 2, 9) AS accuracy,
 round(CASE WHEN c IS NULL THEN p WHEN p IS NULL THEN c ELSE (c + p) / 2 END / 1000, 9) AS reaction_time FROM s LEFT JOIN f USING (user_id, window_index)"""


@query
def hrv_time_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variability of the gaps between a user's events in two-day windows."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    found = physiology.hrv_time(physiology.rr_intervals(dealt, ["user_id", "window_index"], "t"), ["user_id", "window_index"])
    return rounded(found, *[c for c in found.columns if c not in ("user_id", "window_index", "n_peaks")], places=3)


SQL["hrv_time_domain"] = f"""WITH {TIME_WINDOWS}, r AS (SELECT user_id, window_index, (t - lag(t) OVER (PARTITION BY user_id, window_index ORDER BY t)) * 1000 AS rr, t FROM w),
d AS (SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, window_index ORDER BY t) AS drr FROM r),
a AS (SELECT user_id, window_index, count(*) AS n_peaks, avg(rr) AS m, stddev_samp(rr) AS sdnn, stddev_samp(drr) AS sdsd, sqrt(avg(drr * drr)) AS rmssd, quantile_cont(rr, 0.5) AS med, quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25) AS iqr,
 count(*) FILTER (abs(drr) > 50) * 100.0::DOUBLE / count(rr) AS p50, count(*) FILTER (abs(drr) > 20) * 100.0::DOUBLE / count(rr) AS p20, min(rr) AS lo, max(rr) AS hi FROM d GROUP BY ALL HAVING count(*) >= 5),
s AS (SELECT *, sdsd / sqrt(2) AS sd1, sqrt(greatest(2 * sdnn * sdnn - sdsd * sdsd / 2, 0)) AS sd2 FROM a)
SELECT user_id, window_index, n_peaks, round(60000 / m, 3) AS heart_rate_mean, round(m, 3) AS hrv_mean_nn, round(sdnn, 3) AS hrv_sdnn, round(rmssd, 3) AS hrv_rmssd, round(sdsd, 3) AS hrv_sdsd, round(sdnn / m, 3) AS hrv_cvnn, round(med, 3) AS hrv_median_nn, round(iqr, 3) AS hrv_iqr_nn,
 round(p50, 3) AS hrv_pnn50, round(p20, 3) AS hrv_pnn20, round(lo, 3) AS hrv_min_nn, round(hi, 3) AS hrv_max_nn, round(sd1, 3) AS hrv_sd1, round(sd2, 3) AS hrv_sd2, round(sd1 / nullif(sd2, 0), 3) AS hrv_sd1sd2 FROM s"""


@query
def eda_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as responses, with the value as signal and its centred median as tonic level."""
    e = events(spark, sf_dir).withColumn("tonic", calculus.rolling_median("value", ["user_id"], ORDER)).withColumn("peak", F.col("event_type") == "purchase")
    dealt = windows.by_time(e, ["user_id"], "t", 2 * DAY, DAY)
    found = physiology.eda(dealt, ["user_id", "window_index"], ORDER, "peak", "value", "tonic", "value")
    return rounded(found, "scr_peaks_amplitude_mean", "eda_tonic_sd", "eda_autocorrelation")


SQL["eda_window_features"] = f"""WITH {TIME_WINDOWS.replace("max(t) OVER (PARTITION BY user_id) AS last FROM e", f"max(t) OVER (PARTITION BY user_id) AS last, quantile_cont(value, 0.5) OVER {FIVE} AS tonic FROM e")},
p AS (SELECT *, lag(value) OVER (PARTITION BY user_id, window_index ORDER BY t, event_id) AS prev FROM w)
SELECT user_id, window_index, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS scr_peaks_n, round(avg(value) FILTER (event_type = 'purchase'), 6) AS scr_peaks_amplitude_mean, round(stddev_samp(tonic), 6) AS eda_tonic_sd,
 round(CASE WHEN isnan(corr(value, prev)) THEN NULL ELSE corr(value, prev) END, 6) AS eda_autocorrelation FROM p GROUP BY ALL"""


@query
def butterworth_zero_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-pass of each user's values, split where an error stands."""
    e = events(spark, sf_dir).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return signal.low_pass(e, "user_id", ORDER, "x", cutoff=10.0, rate=60.0)


@query
def fixation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells in which a user's value stays near where it was; the state starts anew in each two-day window."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY).withColumn("zero", F.lit(0.0))
    return matching.fixations(dealt, ["user_id", "window_index"], "t", "value", "zero", radius=25.0, least=3600.0)


@query
def saccade_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two rows of high speed and acceleration."""
    d = calculus.derivatives(events(spark, sf_dir), "value", ["user_id"], ORDER)
    fast = (F.abs("value_vel") > 15) & (F.abs("value_acc") > 5)
    found = calculus.runs(d, fast, ["user_id"], ORDER, "t").where("n >= 2")
    return rounded(found.select("user_id", "start", "end", "n"), "start", "end", places=5)


SQL["saccade_runs"] = f"""WITH {EVENTS}, {_gradient_sql("value", "e", "v")}, {_gradient_sql("vx", "v", "a")},
f AS (SELECT *, coalesce(abs(vx) > 15 AND abs(ax) > 5, false) AS hit FROM a),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, hit ORDER BY t, event_id) AS g FROM f)
SELECT user_id, round(min(t), 5) AS start, round(max(t), 5) AS end, count(*) AS n FROM g WHERE hit GROUP BY user_id, g HAVING count(*) >= 2"""


@query
def gaze_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing share, dispersion and mean speed of windows of which at most a quarter is missing; the index goes on."""
    e = events(spark, sf_dir).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    dealt = windows.by_time(e, ["user_id"], "t", 2 * DAY, DAY)
    part = Window.partitionBy("user_id", "window_index").orderBy(*ORDER)
    moved = dealt.withColumn("speed", F.try_divide(F.abs(F.col("x") - F.lag("x").over(part)), F.col("t") - F.lag("t").over(part)))
    found = moved.groupBy("user_id", "window_index").agg(
        F.avg(F.col("x").isNull().cast("double")).alias("pct_missing"), F.stddev_pop("x").alias("rms_disp"), F.avg("speed").alias("mean_vel"), F.max("speed").alias("max_vel"),
        F.try_divide(F.count_if(F.col("event_type") == "click").cast("double"), F.max("t") - F.min("t")).alias("click_rate"),
    )
    return rounded(found.where("pct_missing <= 0.25"), "pct_missing", "rms_disp", "mean_vel", "max_vel", "click_rate")


SQL["gaze_window_metrics"] = f"""WITH {TIME_WINDOWS}, x AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS x FROM w),
s AS (SELECT *, abs(x - lag(x) OVER q) / nullif(t - lag(t) OVER q, 0) AS speed FROM x WINDOW q AS (PARTITION BY user_id, window_index ORDER BY t, event_id))
SELECT user_id, window_index, round(avg((x IS NULL)::INT), 6) AS pct_missing, round(stddev_pop(x), 6) AS rms_disp, round(avg(speed), 6) AS mean_vel, round(max(speed), 6) AS max_vel, round(count(*) FILTER (event_type = 'click') / nullif(max(t) - min(t), 0), 6) AS click_rate
FROM s GROUP BY ALL HAVING avg((x IS NULL)::INT) <= 0.25"""


def framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place among the user's, counted over stretches of a day."""
    return slices.framed(events(spark, sf_dir), ["user_id"], "t", ORDER, DAY)


#: Rows of a slice in the queries: few, so that users have several.
FEW = 16


@query
def sliced_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slices.derivatives(framed_events(spark, sf_dir), "value", ["user_id"], size=FEW)
    return rounded(found.select("user_id", "event_id", "value_vel", "value_acc"), "value_vel", "value_acc")


@query
def sliced_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(slices.rolling_median(framed_events(spark, sf_dir), "value", "median5", ["user_id"], size=FEW).select("user_id", "event_id", "median5"), "median5")


@query
def sliced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slices.runs(framed_events(spark, sf_dir), F.col("value") > 40, ["user_id"], "t", FEW).where("n >= 2")
    return rounded(found.select("user_id", "start", "end", "n", (F.col("end") - F.col("start")).alias("duration")), "start", "end", "duration", places=5)


@query
def sliced_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = framed_events(spark, sf_dir).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(slices.interpolated(x, "x", ["user_id"], 2, FEW).select("user_id", "event_id", "x_filled"), "x_filled")


for _sliced, _plain in (("sliced_gradient", "gradient_vel_acc"), ("sliced_rolling_median", "rolling_median5"), ("sliced_runs", "runs_islands"), ("sliced_interpolation", "interp_limited")):
    SQL[_sliced] = SQL[_plain]


@query
def sliced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of sixteen items every eight over each supplier's items, whose places come from counts over stretches of orders: a hot supplier is no task's."""
    items = slices.framed(table(spark, sf_dir, "lineitem").select("l_suppkey", *ITEM_ORDER), ["l_suppkey"], "l_orderkey", ITEM_ORDER, 5_000.0)
    dealt = windows.by_frame(items, 16, 8).groupBy("l_suppkey", "window_index").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.avg("l_extendedprice").alias("mean"))
    return rounded(dealt, "mean", places=4)


SQL["sliced_frames"] = f"""WITH f AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ITEM_ORDER)}) - 1 AS frame, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem),
w AS (SELECT *, unnest(range(greatest(0, ceil((frame - 15) / 8.0))::BIGINT, frame // 8 + 1))::INT AS window_index FROM f)
SELECT l_suppkey, window_index, count(*) AS n, min(frame) AS first_frame, round(avg(l_extendedprice), 4) AS mean FROM w WHERE window_index * 8 + 16 <= total GROUP BY 1, 2"""
