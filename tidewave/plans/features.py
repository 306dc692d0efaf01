"""Queries on feature tables and on the evaluation of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, features, mixed, physiology, splits, statistics, windows
from .series import ORDER, TIME_WINDOWS
from .tables import DAY, EVENTS, events, rounded, table
from .tabular import CONDITIONS, HASH, KINDS, _conditions, _predictions

Q = {}
SQL = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the events' JSON, by kind."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k.cast("long")).alias("total"), F.max(k).alias("most"))


SQL["json_properties"] = "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY 1"


@query
def event_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


SQL["event_type_filter"] = "SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL"


@query
def complete_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with both coordinates, of the first fifty frames of each user."""
    framed = windows.by_count(events(spark, sf_dir), ["user_id"], ORDER, 1, 1)
    cut = features.first_seconds(framed, "frame", 10.0, 5.0).withColumns({"x": F.when(F.col("event_type") != "error", F.col("value")), "y": F.when(F.col("value") < 90, F.col("value") * 2)})
    return cut.dropna(subset=["x", "y"]).select("user_id", "event_id", "frame", "x", "y")


SQL["complete_samples"] = f"""WITH {EVENTS}, f AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1)::INT AS frame FROM e)
SELECT user_id, event_id, frame, value AS x, value * 2 AS y FROM f WHERE frame < 50 AND event_type <> 'error' AND value < 90"""


@query
def gaze_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.col("value").alias("R Gaze X"), (F.col("t") % 1440).alias("R Gaze Y"))
    return rounded(features.scaled_gaze(e, {"R Gaze X": 2560.0, "R Gaze Y": 1440.0}), "R Gaze Y", "R Gaze Y Norm")


SQL["gaze_scaled"] = f"""WITH {EVENTS} SELECT event_id, value AS "R Gaze X", round(t % 1440, 6) AS "R Gaze Y", value / 2560 AS "R Gaze X Norm", round(t % 1440 / 1440, 6) AS "R Gaze Y Norm" FROM e"""


@query
def interocular_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of a vector's first two points, unless one of the next two components, taken as confidences, is low."""
    at = lambda i: F.col("embedding")[i].cast("double")
    found = features.masked_interocular(at(0), at(1), F.abs(at(4)), at(2), at(3), F.abs(at(5)), 0.05)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", found.alias("interocular")), "interocular")


SQL["interocular_masked"] = """SELECT vec_id, CASE WHEN NOT (abs(e[5]) < 0.05 OR abs(e[6]) < 0.05) THEN round(sqrt((e[1] - e[3]) ** 2 + (e[2] - e[4]) ** 2), 6) END AS interocular
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"""


@query
def linear_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    return rounded(features.linear_metrics(dealt, ["user_id", "window_index"], "value", ORDER), "mean_abs_vel", "mean_abs_acc", "rms_dev")


SQL["linear_window_metrics"] = f"""WITH {TIME_WINDOWS}, v AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, window_index ORDER BY t, event_id) AS v FROM w),
a AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id, window_index ORDER BY t, event_id) AS a FROM v)
SELECT user_id, window_index, count(value) AS n, round(avg(abs(v)), 6) AS mean_abs_vel, round(avg(abs(a)), 6) AS mean_abs_acc, round(stddev_pop(value), 6) AS rms_dev FROM a GROUP BY ALL"""


@query
def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(F.countDistinct("user_id").alias("participants"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("conditions"))


SQL["distinct_levels"] = "SELECT count(DISTINCT user_id) AS participants, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS conditions FROM events"


@query
def rms_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each ``_rms`` column of a table of windows."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    wide = dealt.groupBy("user_id", "window_index").agg(*[F.sqrt(F.avg(F.when(F.col("event_type") == k, F.col("value") * F.col("value")))).alias(f"{k}_rms") for k in KINDS], F.avg("value").alias("value_mean"))
    return rounded(features.means_of(wide, "_rms"), "mean")


SQL["rms_means"] = f"""WITH {TIME_WINDOWS}, r AS (SELECT user_id, window_index, {", ".join(f"sqrt(avg(value * value) FILTER (event_type = '{k}')) AS {k}_rms" for k in KINDS)} FROM w GROUP BY ALL)
SELECT unnest([{", ".join(f"'{k}_rms'" for k in KINDS)}]) AS metric, unnest([{", ".join(f"round(avg({k}_rms), 6)" for k in KINDS)}]) AS mean FROM r"""


@query
def ranked_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three kinds of event by mean value, best first."""
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"), "event_type").limit(3), "mean")


SQL["ranked_kinds"] = "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 3"


@query
def sorted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by window in the order of their keys, as an export has them."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    return dealt.groupBy("user_id", "window_index").agg(F.count("*").alias("n")).orderBy("user_id", "window_index")


SQL["sorted_windows"] = f"WITH {TIME_WINDOWS} SELECT user_id, window_index, count(*) AS n FROM w GROUP BY ALL ORDER BY 1, 2"


@query
def null_counts_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns with the most NULLs."""
    e = events(spark, sf_dir).withColumns({"no_error": F.when(F.col("event_type") != "error", F.col("value")), "high": F.when(F.col("value") > 50, F.col("value"))})
    return statistics.null_counts(e, ["value", "no_error", "high"]).orderBy(F.desc("nulls"), "column").limit(2)


SQL["null_counts_first"] = """SELECT unnest(['value', 'no_error', 'high']) AS column, unnest([count(*) FILTER (value IS NULL), count(*) FILTER (event_type = 'error'), count(*) FILTER (value IS NULL OR value <= 50)]) AS nulls FROM events ORDER BY nulls DESC, 1 LIMIT 2"""


@query
def histogram_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of fifty cells, each with the mean and sd of the whole column."""
    items = table(spark, sf_dir, "lineitem")
    whole = items.where(F.col("l_discount").between(0.0, 0.1)).agg(F.avg("l_discount").alias("mean"), F.stddev_pop("l_discount").alias("std"))
    return rounded(statistics.histogram(items, "l_discount", 0.0, 0.1, 50).crossJoin(F.broadcast(whole)), "mean", "std")  # one row


SQL["histogram_moments"] = """SELECT least(floor(50 * l_discount / 0.1::DOUBLE)::INT + 1, 50) AS bin, count(*) AS n, (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1) AS mean, (SELECT round(stddev_pop(l_discount), 6) FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1) AS std
FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1"""


@query
def window_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a user's windows of eight rows lack a value of each of two metrics."""
    dealt = windows.by_count(events(spark, sf_dir), ["user_id"], ORDER, 8, 4)
    per = dealt.groupBy("user_id", "window_index").agg(F.count(F.when(F.col("event_type") != "error", 1)).alias("a"), F.count(F.when(F.col("value") < 150, 1)).alias("b"))
    return per.groupBy("user_id").agg(F.count("*").alias("n_windows"), F.count_if(F.col("a") < 8).alias("dropped_a"), F.count_if(F.col("b") < 8).alias("dropped_b"))


SQL["window_drop_counts"] = f"""WITH {EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n FROM e),
w AS (SELECT f.*, k FROM f, range(0, 20000) g(k) WHERE 4 * k <= frame AND frame < 4 * k + 8 AND 4 * k + 8 <= n),
p AS (SELECT user_id, k, count(*) FILTER (event_type <> 'error') AS a, count(*) FILTER (value < 150) AS b FROM w GROUP BY ALL)
SELECT user_id, count(*) AS n_windows, count(*) FILTER (a < 8) AS dropped_a, count(*) FILTER (b < 8) AS dropped_b FROM p GROUP BY 1"""


@query
def pooled_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each user's events of two kinds, pooled over users, counted by kind."""
    parts = [splits.first_of(events(spark, sf_dir).where(F.col("event_type") == k), ["user_id"], ORDER, 5).where("side = 'train'") for k in ("click", "view")]
    return rounded(parts[0].unionByName(parts[1]).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


SQL["pooled_train"] = f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS r FROM e WHERE event_type IN ('click', 'view'))
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM r WHERE r <= 5 GROUP BY 1"""


@query
def model_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a table of features: usual names, no identifiers or derivatives, no missing values."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("participant"), F.col("l_linenumber").alias("window"), "l_returnflag", F.when(F.col("l_quantity") > 5, F.log(F.col("l_quantity") - 6)).alias("q_rms"), F.col("l_tax").alias("tax_vel_mean"), F.col("l_discount").alias("disc_mean"),
    )
    kept = features.model_features(features.renamed(items, {"window": "window_index"}), derivatives=False, keep=("participant",))
    return rounded(kept, "q_rms", "disc_mean")


SQL["model_feature_table"] = "SELECT l_orderkey AS participant, CASE WHEN l_quantity > 6 THEN round(ln(l_quantity - 6), 6) ELSE 0 END AS q_rms, round(l_discount, 6) AS disc_mean FROM lineitem"


@query
def prepared_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as conditions L, M and H in messy writing, in their order, with mean and standard error."""
    raw = table(spark, sf_dir, "customer").withColumn("c", F.when(F.col("c_mktsegment") == "BUILDING", " l").when(F.col("c_mktsegment") == "MACHINERY", "H ").otherwise("x"))
    ready = features.prepared(raw, "c_custkey", "c")
    return rounded(features.by_condition(ready, "condition", "c_acctbal").withColumn("place", features.condition_rank(F.col("condition"))), "mean", "sem", places=4)


SQL["prepared_conditions"] = """WITH c AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'L' WHEN 'MACHINERY' THEN 'H' END AS condition, c_acctbal AS x FROM customer),
o(rank, condition) AS (VALUES (1, 'L'), (2, 'M'), (3, 'H'))
SELECT rank, o.condition, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x) / sqrt(count(x)), 4) AS sem, rank AS place FROM o LEFT JOIN c ON o.condition = c.condition GROUP BY ALL"""


@query
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial in which a customer's nation had the condition of the customer's segment."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("participant"), F.substring("c_mktsegment", 1, 1).alias("condition"))
    return features.session_of(rows, _conditions(spark, sf_dir)).select("c_custkey", "trial")


SQL["session_lookup"] = f"""WITH {CONDITIONS}, f AS (SELECT participant, condition, min(trial) AS trial FROM m GROUP BY ALL)
SELECT c_custkey, trial FROM customer LEFT JOIN f ON participant = c_nationkey::VARCHAR AND condition = substr(c_mktsegment, 1, 1)"""


@query
def condition_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three sessions; nations without one of them have none."""
    info = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.substring("n_name", 1, 1).alias("session01"), F.when(F.col("n_regionkey") == 2, "-").otherwise("M").alias("session02"), F.when(F.col("n_nationkey") % 4 > 0, " H ").alias("session03"))
    return features.condition_orders(info, "id", ["session01", "session02", "session03"])


SQL["condition_order_rows"] = "SELECT n_nationkey::VARCHAR AS participant, substr(n_name, 1, 1) || 'MH' AS condition_order FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 4 > 0"


@query
def window_event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean duration and rate of purchases, taken as intervals, that start within each window."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    spans = dealt.groupBy("user_id", "window_index").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    intervals = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("end"))
    found = features.event_metrics(spans, intervals, "user_id", "blink", DAY)
    return rounded(found.withColumn("blink_rate", F.col("blink_rate") * DAY), "first", "last", "blink_mean_dur", "blink_rate", places=5)


SQL["window_event_metrics"] = f"""WITH {TIME_WINDOWS}, s AS (SELECT user_id, window_index, min(t) AS first, max(t) AS last FROM w GROUP BY ALL)
SELECT s.user_id, s.window_index, round(first, 5) AS first, round(last, 5) AS last, count(p.t) AS blink_count, round(coalesce(avg(p.t + p.value - p.t), 0), 5) AS blink_mean_dur, round(count(p.t) / nullif(last - first, 0) * {DAY}, 5) AS blink_rate
FROM s LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON p.user_id = s.user_id AND p.t BETWEEN first AND last GROUP BY s.user_id, s.window_index, first, last"""


@query
def hrv_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asymmetry of the gaps between a user's events in eight-day windows, in hours."""
    keys = ["user_id", "window_index"]
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 8 * DAY, 4 * DAY)
    rr = physiology.rr_intervals(dealt, keys, "t").where("rr is not null").withColumn("place", F.col("t"))
    found = features.asymmetry(rr.withColumns({"rr": F.col("rr") / 3.6e6, "drr": F.col("drr") / 3.6e6}), keys)
    return rounded(found, *found.columns[3:], places=4)


_EIGHT = TIME_WINDOWS.replace(f"k * {DAY} <= t AND t < k * {DAY} + {2 * DAY} AND k * {DAY} < last - {2 * DAY} + 1", f"k * {4 * DAY} <= t AND t < k * {4 * DAY} + {8 * DAY} AND k * {4 * DAY} < last - {8 * DAY} + 1")
SQL["hrv_asymmetry"] = f"""WITH {_EIGHT}, r AS (SELECT user_id, window_index, t, (t - lag(t) OVER (PARTITION BY user_id, window_index ORDER BY t)) / 3600 AS rr FROM w),
d AS (SELECT *, rr - lag(rr) OVER k AS d, lag(rr) OVER k AS p FROM r WINDOW k AS (PARTITION BY user_id, window_index ORDER BY t)),
x AS (SELECT *, lead(d) OVER (PARTITION BY user_id, window_index ORDER BY t) * d AS turn, rr + p - 2 * avg(rr) OVER (PARTITION BY user_id, window_index) AS along FROM d WHERE rr IS NOT NULL),
s AS (SELECT user_id, window_index, count(d) AS n, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, coalesce(sum(d * d) FILTER (d > 0), 0) AS d1, coalesce(sum(d * d) FILTER (d < 0), 0) AS a1,
 coalesce(sum(CASE WHEN d > 0 THEN along * along WHEN d = 0 THEN along * along / 2 END), 0) AS d2, coalesce(sum(CASE WHEN d < 0 THEN along * along WHEN d = 0 THEN along * along / 2 END), 0) AS a2, count(*) FILTER (turn < 0) AS turns, count(turn) AS neighbours FROM x GROUP BY ALL HAVING count(d) > 0)
SELECT user_id, window_index, n, round(100.0 * turns / nullif(neighbours, 0), 4) AS hrv_pip, round(100.0 * down / nullif(up + down, 0), 4) AS hrv_pi, round(100 * d1 / nullif(d1 + a1, 0), 4) AS hrv_gi, round(sqrt(d1 / (2 * n)), 4) AS hrv_sd1d, round(sqrt(a1 / (2 * n)), 4) AS hrv_sd1a, round(sqrt(d2 / (2 * n)), 4) AS hrv_sd2d,
 round(sqrt(a2 / (2 * n)), 4) AS hrv_sd2a, round(100 * d2 / nullif(d2 + a2, 0), 4) AS hrv_c2d, round(100 * a2 / nullif(d2 + a2, 0), 4) AS hrv_c2a, round(100 * a1 / nullif(d1 + a1, 0), 4) AS hrv_c1a, round(sqrt((d1 + d2) / (4 * n)), 4) AS hrv_sdnnd, round(sqrt((a1 + a2) / (4 * n)), 4) AS hrv_sdnna FROM s"""


@query
def beat_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a user's events as intervals, those far from their neighbours corrected: quality and mean rate, a day."""
    rr = physiology.rr_intervals(events(spark, sf_dir), ["user_id"], "t")
    found = physiology.signal_quality(physiology.corrected(rr, ["user_id"], "t", share=0.5), ["user_id"])
    return rounded(found.withColumn("rate_mean", F.col("rate_mean") * 1440), "quality", "rate_mean", places=5)


SQL["beat_quality"] = f"""WITH {EVENTS}, r AS (SELECT user_id, t, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) * 1000 AS rr FROM e),
m AS (SELECT *, quantile_cont(rr, 0.5) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM r),
c AS (SELECT *, abs(rr - m) > 0.5 * m AS artefact FROM m WHERE rr IS NOT NULL)
SELECT user_id, count(*) AS n, round(avg((NOT artefact)::INT), 5) AS quality, round(avg(60000 / CASE WHEN artefact THEN m ELSE rr END) * 1440, 5) AS rate_mean FROM c GROUP BY 1"""


@query
def per_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.per_class(_predictions(spark, sf_dir), [], "quality", "guess"), "precision", "recall", "f1")


SQL["per_class_scores"] = """WITH p AS (SELECT quality AS t, (n_chars > 700)::INT AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT class, (SELECT count(*) FROM p WHERE t = class) AS actual, (SELECT count(*) FROM p WHERE p = class) AS said, (SELECT count(*) FROM p WHERE t = class AND p = class) AS hit FROM (SELECT t AS class FROM p UNION SELECT p FROM p))
SELECT class, actual AS support, round(coalesce(hit / nullif(said, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hit / nullif(actual, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * hit / nullif(actual + said, 0)::DOUBLE, 0), 6) AS f1 FROM c"""

FEATURES = ["value", "hour"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3600).cast("double") % 24)


SAMPLES = f"{EVENTS}, x AS (SELECT *, floor(t / 3600) % 24 AS hour FROM e)"


def _nearest(train: str, test: str, keys: str) -> str:
    """SQL: ``test`` with the class whose mean over ``train`` (keys, event_type, n, sums and squares) is nearest."""
    return f"""sp AS (SELECT {keys}, {", ".join(f"sqrt(greatest(sum(q_{f}) / sum(n) - (sum(s_{f}) / sum(n)) ** 2, 0)) AS sd_{f}" for f in FEATURES)} FROM {train} GROUP BY ALL),
ds AS (SELECT a.*, b.event_type AS class, round({" + ".join(f"coalesce((a.{f} - b.s_{f} / b.n) / nullif(sp.sd_{f}, 0), 0) ** 2" for f in FEATURES)}, 9) AS d FROM {test} a JOIN {train} b USING ({keys}) JOIN sp USING ({keys})),
pr AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY {keys}, event_id ORDER BY d, class) = 1)"""


_SUMS = "count(*) AS n, " + ", ".join(f"sum({f}) AS s_{f}, sum({f} * {f}) AS q_{f}" for f in FEATURES)
_RECALL = "r AS (SELECT {keys}, event_type, count(*) AS support, count(*) FILTER (class = event_type) AS hit FROM pr GROUP BY ALL)"


@query
def lopo_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events predicted by the class means of all other users: the score of each fold."""
    predicted = evaluation.leave_one_out(_samples(spark, sf_dir), "user_id", "event_type", FEATURES)
    return rounded(evaluation.fold_scores(predicted, ["user_id"], "event_type", "predicted").select("user_id", "n", "accuracy", "balanced_accuracy"), "accuracy", "balanced_accuracy")


_NAMES = ["n", *[f"{k}_{f}" for f in FEATURES for k in "sq"]]
_LOPO = f"""{SAMPLES}, o AS (SELECT user_id, event_type, {_SUMS} FROM x GROUP BY ALL), al AS (SELECT event_type, {", ".join(f"sum({c}) AS a_{c}" for c in _NAMES)} FROM o GROUP BY 1),
tr AS (SELECT u.user_id, al.event_type, {", ".join(f"a_{c} - coalesce({c}, 0) AS {c}" for c in _NAMES)} FROM (SELECT DISTINCT user_id FROM o) u CROSS JOIN al LEFT JOIN o ON o.user_id = u.user_id AND o.event_type = al.event_type WHERE a_n - coalesce(n, 0) > 0),
{_nearest("tr", "x", "user_id")}, {_RECALL.format(keys="user_id")}"""
SQL["lopo_class_means"] = f"WITH {_LOPO} SELECT user_id, sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(hit / support), 6) AS balanced_accuracy FROM r GROUP BY 1"


@query
def participant_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of single users by the number of first events of each kind they learn from, from two on: mean and spread over users."""
    sized = evaluation.temporal_sides(_samples(spark, sf_dir), ["user_id", "event_type"], ORDER, [1, 2, 4, 6])
    keys = ["user_id", "train_size"]
    predicted = evaluation.by_class_means(sized.where("side = 'train'"), sized.where("side = 'test'"), keys, "event_type", FEATURES)
    found = evaluation.fold_scores(predicted, keys, "event_type", "predicted").where("train_size >= 2")
    return rounded(statistics.over_seeds(found, [keys, ["train_size"]], "balanced_accuracy"), "balanced_accuracy_mean", "balanced_accuracy_std", places=5)


SQL["participant_curve"] = f"""WITH {SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM x),
z AS (SELECT p.*, train_size, CASE WHEN r <= train_size THEN 'train' ELSE 'test' END AS side FROM p, (VALUES (1), (2), (4), (6)) g(train_size) WHERE c >= train_size + 2 AND r <> train_size + 1),
tr AS (SELECT user_id, train_size, event_type, {_SUMS} FROM z WHERE side = 'train' GROUP BY ALL), te AS (SELECT * FROM z WHERE side = 'test'),
{_nearest("tr", "te", "user_id, train_size")}, {_RECALL.format(keys="user_id, train_size")},
b AS (SELECT user_id, train_size, avg(hit / support) AS b FROM r GROUP BY ALL)
SELECT train_size, round(avg(b), 5) AS balanced_accuracy_mean, round(stddev_samp(b), 5) AS balanced_accuracy_std, count(*) AS n FROM b WHERE train_size >= 2 GROUP BY 1"""


@query
def seeded_single_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model of all users, over three seeds of a stratified split: the scores of each."""
    parts = [splits.stratified(_samples(spark, sf_dir), "event_type", "event_id", 0.8, seed=s).withColumn("seed", F.lit(s)) for s in (1, 2, 3)]
    sided = parts[0].unionByName(parts[1]).unionByName(parts[2])
    predicted = evaluation.by_class_means(sided.where("side = 'train'"), sided.where("side = 'test'"), ["seed"], "event_type", FEATURES)
    return rounded(evaluation.fold_scores(predicted, ["seed"], "event_type", "predicted").select("seed", "n", "accuracy", "balanced_accuracy"), "accuracy", "balanced_accuracy")


SQL["seeded_single_model"] = f"""WITH {SAMPLES}, z AS ({" UNION ALL ".join(f"SELECT *, {s} AS seed, row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format(seed=s)}, event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.8) AS is_train FROM x" for s in (1, 2, 3))}),
tr AS (SELECT seed, event_type, {_SUMS} FROM z WHERE is_train GROUP BY ALL), te AS (SELECT * FROM z WHERE NOT is_train),
{_nearest("tr", "te", "seed")}, {_RECALL.format(keys="seed")}
SELECT seed, sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(hit / support), 6) AS balanced_accuracy FROM r GROUP BY 1"""


@query
def estimated_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of event kinds at the mean day, from the mixed model with a random intercept for users; the tests hold it against a plain fit."""
    e = events(spark, sf_dir).withColumns({"day": F.floor(F.col("t") / DAY).cast("double"), "day_part": F.col("t") % DAY / DAY})
    return mixed.estimated_means(e, "user_id", ["value", "day_part"], "event_type", ["click", "purchase", "view"], ["day"])
