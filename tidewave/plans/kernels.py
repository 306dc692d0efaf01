"""Queries of signal kernels and of model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calculus, evaluation, physiology, selection, splits, windows
from .series import FIVE, ORDER, TIME_WINDOWS
from .tables import DAY, EVENTS, events, rounded, table

Q = {}
SQL = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def r_peak_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of each user's values, taken as ten samples a second."""
    return physiology.r_peaks(events(spark, sf_dir), ["user_id"], ORDER, "value", 10.0)


def _over(before: int, after: int, low: str = "PRECEDING") -> str:
    return f"(PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN {before} {low} AND {after} FOLLOWING)"


SQL["r_peak_detection"] = f"""WITH {EVENTS}, s AS (SELECT *, value - lag(value) OVER p AS d, row_number() OVER p - 1 AS frame FROM e WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, avg(d * d) OVER {_over(1, 1)} AS en FROM s),
h AS (SELECT *, avg(en) OVER {_over(20, 20)} AS lv, coalesce(max(en) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), -1) AS b, coalesce(max(en) OVER {_over(1, 3, "FOLLOWING")}, -1) AS a,
 max({{'height': value, 'back': -frame}}) FILTER (value IS NOT NULL) OVER {_over(1, 1)} AS top FROM g)
SELECT DISTINCT user_id, (-top.back)::INT AS frame, top.height AS height FROM h WHERE en > lv * 1.5 AND en > b AND en >= a AND top IS NOT NULL"""

#: Cycles a day and slower, for events that are hours apart.
SLOW = {"vlf": (0.1 / DAY, 0.5 / DAY), "lf": (0.5 / DAY, 1.5 / DAY), "hf": (1.5 / DAY, 4.0 / DAY)}


@query
def hrv_frequency_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral power of the gaps between a user's events in two-day windows, by slow bands."""
    keys = ["user_id", "window_index"]
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, DAY)
    found = physiology.hrv_frequency(physiology.rr_intervals(dealt, keys, "t"), keys, "t", SLOW)
    power = [f"hrv_{b}" for b in SLOW]  # in seconds squared, as the gaps are hours
    return rounded(rounded(found.withColumns({c: F.col(c) / 1e6 for c in power}), *power, places=1), "hrv_lfn", "hrv_hfn", "hrv_lfhf", places=4)


_GRID = ", ".join(f"('{b}', {lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * ({i} + 0.5) / 8, {hi - lo!r}::DOUBLE)" for b, (lo, hi) in SLOW.items() for i in range(8))
SQL["hrv_frequency_domain"] = f"""WITH {TIME_WINDOWS}, r AS (SELECT user_id, window_index, t, (t - lag(t) OVER (PARTITION BY user_id, window_index ORDER BY t)) * 1000 AS rr FROM w),
c AS (SELECT user_id, window_index, rr, rr - avg(rr) OVER k AS x, 2 * pi() * (t - min(t) OVER k) AS turn FROM r WHERE rr IS NOT NULL WINDOW k AS (PARTITION BY user_id, window_index)),
z AS (SELECT user_id, window_index, band, f, width, count(*) AS n, sum(x * cos(turn * f)) AS c, sum(x * sin(turn * f)) AS s, sum(rr) / 1000 AS span FROM c, (VALUES {_GRID}) g(band, f, width) GROUP BY ALL),
p AS (SELECT user_id, window_index, any_value(n) AS n_rr, {", ".join(f"sum(2 * (c * c + s * s) * span / (n * n) * width / 8) FILTER (band = '{b}') AS {b}" for b in SLOW)} FROM z GROUP BY ALL HAVING any_value(n) >= 5)
SELECT user_id, window_index, n_rr, round(vlf / 1e6, 1) AS hrv_vlf, round(lf / 1e6, 1) AS hrv_lf, round(hf / 1e6, 1) AS hrv_hf, round(lf / (lf + hf), 4) AS hrv_lfn, round(hf / (lf + hf), 4) AS hrv_hfn, round(lf / hf, 4) AS hrv_lfhf FROM p"""


@query
def hrv_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and scaling exponent of the gaps between a user's events in twenty-day windows; the tests hold both against plain forms."""
    keys = ["user_id", "window_index"]
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", 20 * DAY, 10 * DAY)
    return physiology.hrv_nonlinear(physiology.rr_intervals(dealt, keys, "t"), keys, "t")


@query
def eda_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonic and phasic parts of each user's values and the responses in the latter."""
    return physiology.scr_peaks(physiology.eda_split(events(spark, sf_dir), "user_id", ORDER, "value", rate=1.0, cutoff=0.05), ["user_id"], ORDER, "phasic")


@query
def scr_peak_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of each user's values over their centred median."""
    e = events(spark, sf_dir).withColumn("phasic", F.col("value") - calculus.rolling_median("value", ["user_id"], ORDER))
    return rounded(physiology.scr_peaks(e, ["user_id"], ORDER, "phasic").select("user_id", "event_id", "scr_amplitude", "scr_peak"), "scr_amplitude")


SQL["scr_peak_detection"] = f"""WITH {EVENTS}, m AS (SELECT *, value - quantile_cont(value, 0.5) OVER {FIVE} AS x FROM e),
n AS (SELECT *, lag(x) OVER p AS b, lead(x) OVER p AS a FROM m WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id)),
o AS (SELECT *, last_value(CASE WHEN x < b AND x <= a THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS onset FROM n),
r AS (SELECT *, CASE WHEN x > b AND x >= a THEN x - onset END AS amp FROM o)
SELECT user_id, event_id, round(amp, 6) AS scr_amplitude, coalesce(amp >= 0.1 * max(amp) OVER (PARTITION BY user_id), false) AS scr_peak FROM r"""


@query
def permuted_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the value of another, dealt inside groups of a bounded size."""
    return selection.permuted(events(spark, sf_dir).select("event_id", "event_type", "value"), "event_id", "value", seed=3)


_SPREAD = "((event_id * 2654435761 + {0} * 40503) % 4294967296)"
SQL["permuted_column"] = f"""WITH g AS (SELECT event_id, event_type, value, {_SPREAD.format(3)} % greatest(1, (SELECT count(*) FROM events) // {selection.PERMUTED_TOGETHER}) AS g FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_SPREAD.format(4)} % 1000003, event_id) AS a, row_number() OVER (PARTITION BY g ORDER BY {_SPREAD.format(5)} % 1000003, event_id) AS b FROM g)
SELECT x.event_id, x.event_type, y.value FROM r x JOIN r y ON x.g = y.g AND x.a = y.b"""

TEXT_FEATURES = {"chars": "double(n_chars)", "words": r"double(size(split(text, '\\s+')))", "marks": "double(length(regexp_replace(text, '[^!#$%&*]', '')))", "upper": "double(length(regexp_replace(text, '[^A-Z]', '')))", "lines": r"double(size(split(text, '\n')))"}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(e).alias(c) for c, e in TEXT_FEATURES.items()])
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").dropna(subset=["label"])
    return splits.balanced_weights(rows, "label")


@query
def backward_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics that a forest needs to tell the quality label."""
    make = lambda features: selection.forest(features, trees=10, depth=5)
    steps = selection.backward_elimination(_texts(spark, sf_dir), "doc_id", list(TEXT_FEATURES), folds=5, share=0.2, least=2, make=make)
    return spark.createDataFrame(steps, "step int, n_features int, score double, features array<string>, dropped array<string>")


@query
def lopo_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's quality labels predicted by a forest fitted on all other languages: the scores of each fold."""
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = _texts(spark, sf_dir).join(langs.dropna(), "doc_id").persist()
    folds = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # a model each
    found = evaluation.fitted(rows, "lang", folds, lambda: selection.forest(list(TEXT_FEATURES), trees=20, depth=8))
    return evaluation.fold_scores(found, ["lang"], "label", "prediction")


@query
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As few components of the text statistics as explain 95 % of their variance."""
    from pyspark.ml.functions import vector_to_array

    out, _ = selection.principal_components(_texts(spark, sf_dir), list(TEXT_FEATURES))
    return out.select("doc_id", vector_to_array("components").alias("components"))


@query
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three settings of the forest, scored by cross-validation in three folds."""
    found = selection.random_search(_texts(spark, sf_dir), "doc_id", list(TEXT_FEATURES), {"trees": [10, 20], "depth": [3, 6]}, tries=3, folds=3)
    return spark.createDataFrame([(p["trees"], p["depth"], s) for p, s in found], "trees int, depth int, balanced_accuracy double")
