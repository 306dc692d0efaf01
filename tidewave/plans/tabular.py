"""Queries on tables: lookups, fusion, matching, descriptive statistics, splits, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.columns import stars
from ..operators import calculus, fusion, gram, matching, mixed, splits, statistics, windows
from ..sources import sinks
from .tables import DAY, EVENTS, events, rounded, table

Q = {}
SQL = {}
KINDS = ["click", "error", "purchase", "signup", "view"]


def query(f):
    Q[f.__name__] = f
    return f


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    info = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("session01"), F.when(F.col("n_regionkey") % 2 == 0, "-").otherwise(F.col("r_name")).alias("session02"), F.when(F.col("n_nationkey") % 3 > 0, F.col("r_name")).otherwise("").alias("session03"))
    return fusion.condition_map(info, "n_nationkey", ["session01", "session02", "session03"])


@query
def condition_map_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditions(spark, sf_dir)


CONDITIONS = """m AS (SELECT n_nationkey::VARCHAR AS participant, trial, substr(trim(code), 1, 1) AS condition FROM (SELECT n_nationkey, unnest([1, 2, 3]) AS trial,
 unnest([n_name, CASE WHEN n_regionkey % 2 = 0 THEN '-' ELSE r_name END, CASE WHEN n_nationkey % 3 > 0 THEN r_name ELSE '' END]) AS code FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE trim(code) NOT IN ('', '-'))"""
SQL["condition_map_unpivot"] = f"WITH {CONDITIONS} SELECT participant, trial, condition FROM m"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("string").alias("participant"), (F.col("c_custkey") % 3 + 1).cast("int").alias("trial"))


@query
def condition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = fusion.with_condition(_sessions(spark, sf_dir), _conditions(spark, sf_dir))
    return rounded(statistics.by_group(found, ["condition"], "c_acctbal"), "mean", "sd", "sem", places=4)


SESSIONS = "c AS (SELECT c_custkey, c_acctbal, c_nationkey::VARCHAR AS participant, (c_custkey % 3 + 1)::INT AS trial FROM customer)"
SQL["condition_lookup"] = f"""WITH {CONDITIONS}, {SESSIONS} SELECT condition, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 4) AS sem FROM c JOIN m USING (participant, trial) GROUP BY 1"""


@query
def reject_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = fusion.with_condition(_sessions(spark, sf_dir), _conditions(spark, sf_dir))
    return rejected.groupBy("trial").agg(F.count("*").alias("n"))


SQL["reject_unmapped"] = f"WITH {CONDITIONS}, {SESSIONS} SELECT trial, count(*) AS n FROM c ANTI JOIN m USING (participant, trial) GROUP BY 1"


@query
def fusion_inner_nway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed means of three kinds of event, joined where all three have a window; n is the first's."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    parts = [dealt.where(F.col("event_type") == k).groupBy("user_id", "window_index").agg(F.count("*").alias("n"), F.avg("value").alias(f"{k}_mean")) for k in ("click", "purchase", "view")]
    return rounded(fusion.fuse(parts, ["user_id", "condition", "window_index"]), "click_mean", "purchase_mean", "view_mean")


SQL["fusion_inner_nway"] = f"""WITH {EVENTS}, l AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last FROM e),
w AS (SELECT l.*, k::INT AS window_index FROM l, range(0, 1000) g(k) WHERE k * {DAY} <= t AND t < k * {DAY} + {2 * DAY} AND k * {DAY} < last - {2 * DAY} + 1),
a AS (SELECT user_id, window_index, event_type, count(*) AS n, avg(value) AS m FROM w GROUP BY ALL)
SELECT c.user_id, c.window_index, c.n, round(c.m, 6) AS click_mean, round(p.m, 6) AS purchase_mean, round(v.m, 6) AS view_mean FROM a c JOIN a p USING (user_id, window_index) JOIN a v USING (user_id, window_index) WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND v.event_type = 'view'"""


@query
def order_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation's order of sessions, unknown ones NULL, one-hot."""
    orders = table(spark, sf_dir, "nation").where(F.col("n_regionkey") < 3).select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.substring("n_name", 1, 1), F.lit("MH")).alias("session_order"))
    joined = table(spark, sf_dir, "customer").join(orders, "c_nationkey", "left")
    return fusion.one_hot(joined, "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "session_order", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")


SQL["order_left_lookup"] = """SELECT c_custkey, substr(n_name, 1, 1) || 'MH' AS session_order, (c_mktsegment = 'BUILDING')::INT AS "c_mktsegment_BUILDING", (c_mktsegment = 'MACHINERY')::INT AS "c_mktsegment_MACHINERY"
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey"""

REACH = 21_600.0


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "event_id", "t")


@query
def interval_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click's first purchase within six hours, and the time it took."""
    found = matching.first_match(_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "purchase"), "user_id", "t", "event_id", REACH)
    return rounded(found.select("user_id", "event_id", F.col("matched.row").alias("answer_id"), (F.col("matched.t") - F.col("t")).alias("took")), "took", places=5)


SQL["interval_first_match"] = f"""WITH {EVENTS} SELECT c.user_id, c.event_id, arg_min(p.event_id, (p.t, p.event_id)) AS answer_id, round(min(p.t) - c.t, 5) AS took
FROM e c LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND p.t BETWEEN c.t AND c.t + {REACH} WHERE c.event_type = 'click' GROUP BY c.user_id, c.event_id, c.t"""


@query
def interval_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with an error within six hours, counted by user."""
    found = matching.with_answer(_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "error"), "user_id", "t", REACH)
    return found.groupBy("user_id").agg(F.count("*").alias("n"))


SQL["interval_semi"] = f"""WITH {EVENTS} SELECT user_id, count(*) AS n FROM e c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'error' AND p.user_id = c.user_id AND p.t BETWEEN c.t AND c.t + {REACH}) GROUP BY 1"""


@query
def interval_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event lies within half a day after one of the user's purchases."""
    spans = _kind(spark, sf_dir, "purchase").select("user_id", F.col("t").alias("start"), (F.col("t") + DAY / 2).alias("end"))
    return matching.flagged(events(spark, sf_dir).select("user_id", "event_id", "t"), spans, "user_id", "t", "start", "end", "after_purchase", DAY / 4).drop("t")


SQL["interval_flag"] = f"""WITH {EVENTS} SELECT user_id, event_id, EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND c.t BETWEEN p.t AND p.t + {DAY / 2}) AS after_purchase FROM e c"""


@query
def greedy_consume_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click takes the first purchase within a day that no earlier click took."""
    kind = F.col("event_type")
    return matching.consumed(events(spark, sf_dir), "user_id", "t", "event_id", kind == "click", kind == "purchase", DAY)


@query
def template_mean_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each component, of all vectors (label NULL) and by label, in one pass."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("component", "x"))
    return rounded(long.cube("label", "component").agg(F.grouping_id().alias("g"), F.count("x").alias("n"), F.avg(F.col("x").cast("double")).alias("mean")).where("g in (0, 2)").drop("g"), "mean")


SQL["template_mean_grouping_sets"] = """WITH l AS (SELECT label, generate_subscripts(embedding, 1)::INT - 1 AS component, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, component, count(x) AS n, round(avg(x), 6) AS mean FROM l GROUP BY GROUPING SETS ((label, component), (component))"""

@query
def polar_procrustes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 32 points in the plane, carried onto the mean shape."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    means = long.groupBy("i").agg(F.avg("x").alias("m"))  # a row a component
    part = lambda c, odd: F.max(F.when(F.col("i") % 2 == odd, F.col(c)))
    pairs = long.join(means, "i").groupBy("vec_id", F.floor(F.col("i") / 2).alias("k")).agg(part("x", 0).alias("x"), part("x", 1).alias("y"), part("m", 0).alias("u"), part("m", 1).alias("v"))
    found = pairs.dropna().groupBy("vec_id").agg(*geometry.alignment_sums())
    for step in geometry.solved():
        found = found.withColumns(step)
    names = ["theta", "scale_x", "scale_y", "shift_x", "shift_y"]
    return rounded(found.select("vec_id", *names), *names, places=5)


SQL["polar_procrustes"] = """WITH l AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM l GROUP BY i),
p AS (SELECT vec_id, i // 2 AS k, max(x) FILTER (i % 2 = 0) AS x, max(x) FILTER (i % 2 = 1) AS y, max(m) FILTER (i % 2 = 0) AS u, max(m) FILTER (i % 2 = 1) AS v FROM l JOIN m USING (i) GROUP BY ALL),
s AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, avg(u) AS tx, avg(v) AS ty, var_pop(x) * 32 AS xx, covar_pop(x, y) * 32 AS xy, var_pop(y) * 32 AS yy, covar_pop(x, u) * 32 AS b00, covar_pop(x, v) * 32 AS b01, covar_pop(y, u) * 32 AS b10, covar_pop(y, v) * 32 AS b11 FROM p GROUP BY 1),
a AS (SELECT *, (yy * b00 - xy * b10) / d AS a00, (yy * b01 - xy * b11) / d AS a01, (xx * b10 - xy * b00) / d AS a10, (xx * b11 - xy * b01) / d AS a11 FROM (SELECT *, xx * yy - xy * xy AS d FROM s)),
t AS (SELECT *, CASE WHEN a00 * a11 - a01 * a10 >= 0 THEN 1.0 ELSE -1.0 END AS f FROM a),
r AS (SELECT *, atan2(a10 - f * a01, a00 + f * a11) AS theta FROM t),
c AS (SELECT *, cos(theta) AS c, sin(theta) AS n, cos(theta) * a00 + sin(theta) * a10 AS sx, -f * sin(theta) * a01 + f * cos(theta) * a11 AS sy FROM r)
SELECT vec_id, round(theta, 5) + 0.0 AS theta, round(sx, 5) + 0.0 AS scale_x, round(sy, 5) + 0.0 AS scale_y, round(tx - (mx * c + my * n) * sx, 5) + 0.0 AS shift_x, round(ty - (-f * mx * n + f * my * c) * sy, 5) + 0.0 AS shift_y FROM c"""


@query
def minmax_time_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).groupBy("user_id", "event_type", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))
    return rounded(fusion.time_features(days, ["user_id", "event_type"], "day"), "time_own", "time_all")


SQL["minmax_time_norm"] = f"""WITH {EVENTS}, d AS (SELECT user_id, event_type, floor(t / {DAY})::BIGINT AS day, count(*) AS n FROM e GROUP BY ALL)
SELECT *, round(coalesce((day - min(day) OVER w) / nullif(max(day) OVER w - min(day) OVER w, 0)::DOUBLE, 0.5), 6) AS time_own, round(coalesce((day - min(day) OVER ()) / nullif(max(day) OVER () - min(day) OVER (), 0)::DOUBLE, 0.5), 6) AS time_all FROM d WINDOW w AS (PARTITION BY user_id, event_type)"""


@query
def minute_round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes by rounding half to even, counted."""
    return events(spark, sf_dir).select(F.rint(F.floor(F.col("t") / 30) * 30 / 60).cast("long").alias("minute")).groupBy("minute").agg(F.count("*").alias("n"))


SQL["minute_round_half_even"] = f"WITH {EVENTS} SELECT round_even(floor(t / 30) * 30 / 60, 0)::BIGINT AS minute, count(*) AS n FROM e GROUP BY 1"


@query
def crosstab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.crosstab(events(spark, sf_dir), "user_id", "event_type", KINDS)


SQL["crosstab_counts"] = "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1"


@query
def summary_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.by_group(events(spark, sf_dir), ["event_type"], "value"), "mean", "sd", "sem", places=3)


SQL["summary_by_group"] = "SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS sd, round(stddev_samp(value) / sqrt(count(value)), 3) AS sem FROM events GROUP BY 1"


@query
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.described(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "mean", "sd", "p25", "p50", "p75", places=4)


SQL["describe_columns"] = """WITH l AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS "column", unnest([l_quantity, l_extendedprice, l_discount]) AS x FROM lineitem)
SELECT "column", count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS min, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75, max(x) AS max FROM l GROUP BY 1"""


@query
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"no_error": F.when(F.col("event_type") != "error", F.col("value")), "high": F.when(F.col("value") > 50, F.col("value"))})
    return statistics.null_counts(e, ["value", "no_error", "high"])


SQL["null_counts"] = """SELECT unnest(['value', 'no_error', 'high']) AS column, unnest([count(*) FILTER (value IS NULL), count(*) FILTER (event_type = 'error'), count(*) FILTER (value IS NULL OR value <= 50)]) AS nulls FROM events"""


@query
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(table(spark, sf_dir, "lineitem"), "l_discount", 0.0, 0.1, 50)


SQL["value_histogram"] = "SELECT least(floor(50 * l_discount / 0.1::DOUBLE)::INT + 1, 50) AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1"


@query
def pairwise_complete_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_quantity") < 40, F.col("l_quantity")))
    return rounded(statistics.correlation_between(items, ["l_suppkey"], "q", "l_extendedprice", 10), "r")


SQL["pairwise_complete_corr"] = "SELECT l_suppkey, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem WHERE l_quantity < 40 AND l_extendedprice IS NOT NULL GROUP BY 1 HAVING count(*) > 10"


@query
def corr_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", (F.col("l_tax") * 2 + 1).alias("tax2"), F.lit(1.0).alias("same"))
    return rounded(gram.correlated_columns(items, ["l_quantity", "l_extendedprice", "l_tax", "tax2", "same"], 1e-8, 0.95), "variance", places=2)


SQL["corr_prefilter"] = """SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax', 'tax2', 'same']) AS column, unnest([round(var_pop(l_quantity), 2), round(var_pop(l_extendedprice), 2), round(var_pop(l_tax), 2), round(var_pop(l_tax * 2 + 1), 2), 0.0]) AS variance,
 unnest([var_pop(l_quantity) > 1e-8 AND abs(corr(l_quantity, l_extendedprice)) < 0.95 AND abs(corr(l_quantity, l_tax)) < 0.95, abs(corr(l_extendedprice, l_tax)) < 0.95, abs(corr(l_tax, l_tax * 2 + 1)) < 0.95, true, false]) AS kept FROM lineitem"""



#: Twenty columns of products of three, some of them nearly alike.
WIDE = {f"w{i}": f"l_quantity * {i % 5} + l_tax * {1000 * (i % 3)} + l_discount * {100 * (i % 7)} + l_extendedprice * {0.001 * (i % 2)}" for i in range(20)}


@query
def corr_prefilter_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of twenty columns: 190 pairs from one product of matrices a task."""
    items = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in WIDE.items()])
    return rounded(gram.correlated_columns(items, list(WIDE), 1e-8, 0.95), "variance", places=4)


_ONE = ", ".join([f"var_pop({c}) AS v_{c}" for c in WIDE] + [f"abs(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)) AS r_{a}_{b}" for i, a in enumerate(WIDE) for b in list(WIDE)[i + 1 :]])
_KEPT = ", ".join(f"v_{a} > 1e-8" + "".join(f" AND NOT (v_{b} > 1e-8 AND r_{a}_{b} >= 0.95)" for b in list(WIDE)[i + 1 :]) for i, a in enumerate(WIDE))
SQL["corr_prefilter_wide"] = f"""WITH w AS (SELECT {", ".join(f"({e})::DOUBLE AS {c}" for c, e in WIDE.items())} FROM lineitem), o AS (SELECT {_ONE} FROM w)
SELECT unnest({list(WIDE)}) AS column, unnest([{", ".join(f"round(v_{c}, 4)" for c in WIDE)}]) AS variance, unnest([{_KEPT}]) AS kept FROM o"""

HASH = "(event_id * 2654435761 + {seed} * 40503) % 4294967296"


@query
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(events(spark, sf_dir), "event_type", "event_id", 0.8, seed=7).select("event_id", "event_type", "side")


SQL["split_stratified"] = f"""SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format(seed=7)}, event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.8) THEN 'train' ELSE 'test' END AS side FROM events"""


@query
def split_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_group(events(spark, sf_dir), "user_id", 0.2, seed=3).select("event_id", "user_id", "side")


SQL["split_group"] = f"""WITH g AS (SELECT user_id, row_number() OVER (ORDER BY {HASH.format(seed=3).replace("event_id", "user_id")}, user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, user_id, CASE WHEN r <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS side FROM events JOIN g USING (user_id)"""


@query
def lopo_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds_by_group(events(spark, sf_dir), "user_id").groupBy("fold", "user_id").agg(F.count("*").alias("n_test"))


SQL["lopo_folds"] = "SELECT (dense_rank() OVER (ORDER BY user_id) - 1)::INT AS fold, user_id, count(*) AS n_test FROM events GROUP BY user_id"


@query
def temporal_buffer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal(events(spark, sf_dir), ["user_id", "event_type"], ["t", "event_id"], 5).select("event_id", "user_id", "event_type", "side")


SQL["temporal_buffer_split"] = f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM e)
SELECT event_id, user_id, event_type, CASE WHEN r <= 5 THEN 'train' ELSE 'test' END AS side FROM r WHERE n >= 7 AND r <> 6"""


@query
def class_merge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = fusion.merged_classes(events(spark, sf_dir), "event_type", {"act": ["click", "purchase"], "see": ["view"]})
    return rounded(splits.balanced_weights(merged, "event_type").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("weight").alias("weight")), "weight")


SQL["class_merge_weights"] = """WITH m AS (SELECT CASE WHEN event_type = 'view' THEN 'see' ELSE 'act' END AS event_type FROM events WHERE event_type IN ('click', 'purchase', 'view'))
SELECT event_type, count(*) AS n, round((SELECT count(*) FROM m) / ((SELECT count(DISTINCT event_type) FROM m) * count(*))::DOUBLE, 6) AS weight FROM m GROUP BY 1"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("quality", (F.col("n_chars") > 700).cast("int").alias("guess"))


@query
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a rule on length against the label."""
    return rounded(statistics.scores(_predictions(spark, sf_dir), "quality", "guess"), "accuracy", "balanced_accuracy", "weighted_f1", "kappa")


SQL["confusion_metrics"] = """WITH p AS (SELECT quality AS t, (n_chars > 700)::INT AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT c, (SELECT count(*) FROM p WHERE t = c)::DOUBLE AS actual, (SELECT count(*) FROM p WHERE p = c)::DOUBLE AS said, (SELECT count(*) FROM p WHERE t = c AND p = c)::DOUBLE AS hit FROM (SELECT t AS c FROM p UNION SELECT p FROM p)),
s AS (SELECT sum(actual) AS n, sum(hit) / sum(actual) AS acc, avg(hit / nullif(actual, 0)) AS bal, sum(coalesce(2 * hit / (actual + said), 0) * actual) / sum(actual) AS f1, sum(actual * said) / sum(actual) ** 2 AS chance FROM c)
SELECT n::BIGINT AS n, round(acc, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round(f1, 6) AS weighted_f1, round((acc - chance) / (1 - chance), 6) AS kappa FROM s"""


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.confusion(_predictions(spark, sf_dir), "quality", "guess"), "row_share")


SQL["confusion_matrix"] = """SELECT quality AS truth, (n_chars > 700)::INT AS predicted, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY quality), 6) AS row_share FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"""


@query
def lmm_suffstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("double"))
    found = statistics.sufficient(e, "user_id", "value", ["day"])
    return rounded(found, *found.columns[2:], places=3)


SQL["lmm_suffstats"] = f"""WITH {EVENTS}, d AS (SELECT *, floor(t / {DAY}) AS day FROM e)
SELECT user_id, count(*) AS n, round(sum(value), 3) AS s_value, round(sum(day), 3) AS s_day, round(sum(value * value), 3) AS p_value_value, round(sum(value * day), 3) AS p_value_day, round(sum(day * day), 3) AS p_day_day FROM d GROUP BY 1"""


@query
def lmm_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise contrasts of event kinds with a random intercept for users: t tests by Satterthwaite, adjusted by Tukey and by Holm."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("double"))
    found = mixed.pairwise(e, "user_id", ["value"], "event_type", ["click", "purchase", "view"], ["day"])
    return calculus.holm(found, "p", [], ["a", "b"]).withColumn("mark", stars(F.col("p_holm")))


@query
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small p-like shares by user and kind, adjusted within each user."""
    p = events(spark, sf_dir).groupBy("user_id", "event_type").agg((F.count_if(F.col("value") > 100) / F.count("*")).alias("p"))
    return rounded(calculus.holm(p, "p", ["user_id"], ["event_type"]), "p", "p_holm")


SQL["holm_adjust"] = """WITH p AS (SELECT user_id, event_type, count(*) FILTER (value > 100) / count(*)::DOUBLE AS p FROM events GROUP BY ALL)
SELECT user_id, event_type, round(p, 6) AS p, round(least(1.0, p * (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) + 1)), 6) AS p_holm FROM p"""


@query
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over days, then users, then kinds, with the spread between users."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    return rounded(statistics.over_seeds(e, [["event_type", "user_id", "day"], ["event_type", "user_id"], ["event_type"]], "value"), "value_mean", "value_std")


SQL["learning_curve"] = f"""WITH {EVENTS}, d AS (SELECT event_type, user_id, floor(t / {DAY}) AS day, avg(value) AS v FROM e GROUP BY ALL), u AS (SELECT event_type, user_id, avg(v) AS v FROM d GROUP BY ALL)
SELECT event_type, round(avg(v), 6) AS value_mean, round(stddev_samp(v), 6) AS value_std, count(*) AS n FROM u GROUP BY 1"""


@query
def upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's log of one kind replaced by another's where there is one; new columns widen it."""
    log = lambda kind: events(spark, sf_dir).where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    return fusion.upsert(log("view"), log("purchase").where("n > 12").withColumn("version", F.lit(2)), "user_id")


SQL["upsert_log"] = """WITH l AS (SELECT event_type, user_id, count(*) AS n, max(value) AS best FROM events GROUP BY ALL), new AS (SELECT user_id, n, best, 2::INT AS version FROM l WHERE event_type = 'purchase' AND n > 12)
SELECT user_id, n, best, NULL::INT AS version FROM l WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new"""


@query
def union_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


SQL["union_widen"] = "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier"


@query
def latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a report for each kind of event: mean and sd of two halves of the month, and a share as p."""
    half = lambda first: (F.col("t") < 15 * DAY) if first else (F.col("t") >= 15 * DAY)
    cells = [f(F.when(half(h), F.col("value"))).alias(f"{n}{int(h)}") for h in (True, False) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    wide = events(spark, sf_dir).groupBy("event_type").agg(*cells, (F.count_if(F.col("value") > 200) / F.count("*")).alias("p"))
    return sinks.latex_rows(wide.withColumn("label", F.concat("event_type", F.lit("_value"))), "label", [("m1", "s1"), ("m0", "s0")], ["p"])


SQL["latex_table"] = f"""WITH {EVENTS}, a AS (SELECT event_type, avg(value) FILTER (t < {15 * DAY}) AS m1, stddev_samp(value) FILTER (t < {15 * DAY}) AS s1, avg(value) FILTER (t >= {15 * DAY}) AS m0, stddev_samp(value) FILTER (t >= {15 * DAY}) AS s0, count(*) FILTER (value > 200) / count(*)::DOUBLE AS p FROM e GROUP BY 1)
SELECT event_type || '\\_value & ' || printf('%.2f $\\pm$ %.2f & %.2f $\\pm$ %.2f & ', m1, s1, m0, s0) || CASE WHEN p < 0.001 THEN '<.001' ELSE printf('%.3f', p) END || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END || ' \\\\' AS line FROM a"""


@query
def rf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random forest on text statistics against the quality label, balanced weights, scored on whole held-out sources."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    text = F.col("text")
    features = {"chars": F.col("n_chars").cast("double"), "words": F.size(F.split(text, r"\s+")).cast("double"), "marks": F.length(F.regexp_replace(text, r"[^!#$%&*]", "")).cast("double"), "upper": F.length(F.regexp_replace(text, r"[^A-Z]", "")).cast("double"), "lines": F.size(F.split(text, "\n")).cast("double")}
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", *[v.alias(k) for k, v in features.items()])
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").dropna(subset=["label"])
    rows = rows.withColumn("source_key", F.abs(F.xxhash64("source")) % 1000)
    sided = splits.balanced_weights(splits.by_group(rows, "source_key", 0.2, seed=1), "label").persist()
    names = list(features)
    model = Pipeline(stages=[Imputer(inputCols=names, outputCols=names, strategy="median"), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), RandomForestClassifier(numTrees=30, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="log2", weightCol="weight", seed=1)]).fit(sided.where("side = 'train'"))
    found = statistics.scores(model.transform(sided.where("side = 'test'")), "label", "prediction")
    return found


@query
def event_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error's first purchase within six hours, and the values of the user's next two events after it."""
    kind = F.col("event_type")
    return matching.responses(events(spark, sf_dir), "user_id", "t", "event_id", kind == "error", kind == "purchase", "value", REACH).drop("t")


SQL["event_response"] = f"""WITH {EVENTS}, r AS (SELECT *, lead(value, 1) OVER w AS o, lead(value, 2) OVER w AS re FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT c.event_id, a.event_id AS answer_row, a.o, a.re, row_number() OVER (PARTITION BY c.event_id ORDER BY a.t, a.event_id) AS k FROM e c JOIN r a ON a.user_id = c.user_id AND a.event_type = 'purchase' AND a.t BETWEEN c.t AND c.t + {REACH} WHERE c.event_type = 'error')
SELECT user_id, event_id, answer_row, o AS outcome, re AS reaction FROM e LEFT JOIN (SELECT * FROM p WHERE k = 1) USING (event_id) WHERE event_type = 'error'"""


@query
def sample_temporal_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each user's events are train."""
    return splits.first_of(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 10).select("event_id", "side")


SQL["sample_temporal_first"] = f"WITH {EVENTS} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) <= 10 THEN 'train' ELSE 'test' END AS side FROM e"


@query
def sample_stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each user's events of each kind, drawn by hash, are train."""
    return splits.first_of(events(spark, sf_dir), ["user_id", "event_type"], [splits.spread(F.col("event_id"), 11), "event_id"], 3).select("event_id", "side")


SQL["sample_stratified_draw"] = f"SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY {HASH.format(seed=11)}, event_id) <= 3 THEN 'train' ELSE 'test' END AS side FROM events"


@query
def confusion_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrices of the rule on length, averaged over languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 700).cast("int").alias("guess"))
    found = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rounded(statistics.mean_confusion(found, "lang", "quality", "guess"), "mean")


SQL["confusion_mean"] = """WITH j AS (SELECT lang, quality, (n_chars > 700)::INT AS guess FROM labels JOIN documents USING (doc_id))
SELECT quality AS truth, guess AS predicted, round(count(*) / (SELECT count(*) FROM (SELECT DISTINCT lang FROM j))::DOUBLE, 6) AS mean FROM j GROUP BY 1, 2"""


@query
def sem_from_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard errors worked back from intervals of 1.96 of them around the means."""
    found = statistics.by_group(events(spark, sf_dir), ["user_id"], "value")
    ends = found.select("user_id", (F.col("mean") - 1.96 * F.col("sem")).alias("low"), (F.col("mean") + 1.96 * F.col("sem")).alias("high"))
    return rounded(ends.select("user_id", statistics.sem_from_interval(F.col("low"), F.col("high")).alias("sem")), "sem", places=5)


SQL["sem_from_ci"] = "SELECT user_id, round(stddev_samp(value) / sqrt(count(value)), 5) AS sem FROM events GROUP BY 1"


@query
def importance_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by their mean discounted price over line numbers as folds; the lowest fifth goes, while ten stay."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    folds = items.groupBy("p_brand", "l_linenumber").agg(F.avg(F.col("l_extendedprice") * F.col("l_discount")).alias("importance"))
    return rounded(statistics.eliminated(folds, "p_brand", "importance", 0.2, 10), "importance", places=4)


SQL["importance_elimination"] = """WITH f AS (SELECT p_brand, l_linenumber, avg(l_extendedprice * l_discount) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), m AS (SELECT p_brand, avg(v) AS v FROM f GROUP BY 1),
r AS (SELECT p_brand, v, row_number() OVER (ORDER BY v, p_brand)::INT AS rank, count(*) OVER () AS n FROM m) SELECT p_brand, round(v, 4) AS importance, rank, rank <= least(greatest(1, floor(n * 0.2)), greatest(0, n - 10)) AS dropped FROM r"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return windows.judged(windows.by_time(e, ["user_id"], "t", 2 * DAY, DAY), ["user_id", "window_index"], "x", 0.25, 3)


JUDGED = f"""{EVENTS}, l AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last FROM e),
w AS (SELECT l.*, k::INT AS window_index FROM l, range(0, 1000) g(k) WHERE k * {DAY} <= t AND t < k * {DAY} + {2 * DAY} AND k * {DAY} < last - {2 * DAY} + 1),
a AS (SELECT user_id, window_index, count(*) AS n, avg((event_type = 'error' OR value IS NULL)::INT) AS missing FROM w GROUP BY ALL),
j AS (SELECT *, CASE WHEN n < 3 THEN 'too short' WHEN missing > 0.25 THEN 'too much missing' END AS reason FROM a)"""


@query
def window_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are long enough and not too gappy, every second one, with their first index kept."""
    return rounded(windows.every_nth(_judged(spark, sf_dir).where("status = 'ok'"), 2).select("user_id", "window_index", "n", "missing"), "missing")


SQL["window_validity"] = f"WITH {JUDGED} SELECT user_id, window_index, n, round(missing, 6) AS missing FROM j WHERE reason IS NULL AND window_index % 2 = 0"


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by status and reason."""
    return _judged(spark, sf_dir).groupBy("status", "reason").agg(F.count("*").alias("n"))


SQL["status_counts"] = f"WITH {JUDGED} SELECT CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status, reason, count(*) AS n FROM j GROUP BY ALL"


@query
def tidy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without brackets, no empty column, the segment first."""
    named = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("["), "c_name", F.lit("]")).alias("c_name"), F.lit(None).cast("double").alias("nothing"), "c_mktsegment")
    return fusion.columns_first(fusion.without_brackets(fusion.without_empty(named)), ["c_mktsegment"])


SQL["tidy_columns"] = "SELECT c_mktsegment, c_custkey, replace(replace(c_name, '[', ''), ']', '') AS c_name FROM customer"


@query
def tolerance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a supplier's items without discount, in percent; NULL where it has no returned item."""
    lost = F.col("l_returnflag") == "R"
    rate = F.try_divide(F.count_if(lost & (F.col("l_discount") == 0)) * F.lit(100.0).cast("double"), F.count_if(lost).cast("double"))
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rate.alias("rate")), "rate")


SQL["tolerance_rates"] = "SELECT l_suppkey, round(count(*) FILTER (l_returnflag = 'R' AND l_discount = 0) * 100.0::DOUBLE / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 6) AS rate FROM lineitem GROUP BY 1"
