"""Feature tables on their way to a model: names, identifiers, conditions, event metrics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

#: Columns that identify a window and are no features, and the order of conditions.
IDENTIFIERS = ("condition", "participant", "window_index", "window_start", "window_end", "minute", "window_start_s", "window_end_s", "source", "t_start_frame", "t_end_frame", "start_time", "end_time")
CONDITIONS = ("L", "M", "H")

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def hop_of(size: int, overlap: float) -> int:
    """Rows from one window to the next, at least one; an overlap of one or more falls back to half a window."""
    return max(1, int(size * (1 - overlap))) if overlap < 1 else max(1, size // 2)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their usual name, unless a column has that name already."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})


def model_features(df: DataFrame, derivatives: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns that are no identifiers, without missing values and infinities (0), and ``keep``. ``derivatives`` keeps ``_vel_`` and ``_acc_``."""
    used = [c for c, kind in df.dtypes if (kind in NUMERIC or kind.startswith("decimal")) and c not in IDENTIFIERS and c not in keep and (derivatives or not ("_vel_" in c or "_acc_" in c))]
    return df.select(*keep, *[F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(c) for c in used])


#: Endings of metrics that come first, and metrics that are shown first if they are there: fixed values.
FIRST_ENDINGS = ("_mean_abs_vel", "_mean_abs_acc", "_rms")
FIRST_METRICS = ("blink_aperture_rms", "mouth_aperture_rms", "center_face_magnitude_rms", "blink_aperture_mean_abs_vel", "mouth_aperture_mean_abs_vel")


def metric_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are no identifiers: those with a first ending in any case of letters, then the others."""
    used = [c for c, kind in df.dtypes if c not in IDENTIFIERS and (kind in NUMERIC or kind.startswith("decimal"))]
    return sorted(used, key=lambda c: not c.lower().endswith(FIRST_ENDINGS))


def default_metric(columns: list[str]) -> str | None:
    """A first metric that is there, else the first that ends in _rms, else the first column."""
    by_name = {c.lower(): c for c in reversed(columns)}
    return next((by_name[m] for m in FIRST_METRICS if m in by_name), next((c for c in columns if c.lower().endswith("_rms")), columns[0] if columns else None))


def means_of(df: DataFrame, suffix: str) -> DataFrame:
    """metric, mean of every column that ends in ``suffix``, in one aggregate."""
    used = [c for c in df.columns if c.endswith(suffix)]
    one = df.agg(*[F.avg(f"`{c}`").alias(c) for c in used])
    return one.select(F.expr(f"stack({len(used)}, " + ", ".join(f"'{c}', `{c}`" for c in used) + ") as (metric, mean)"))


def prepared(df: DataFrame, participant: str, condition: str, order: str | None = None) -> DataFrame:
    """``participant_id``, ``condition`` (trimmed, upper case, known ones) and ``session_order_numeric`` (1 where there is none) beside the other columns."""
    clean = F.upper(F.trim(F.col(condition).cast("string")))
    found = df.withColumns({"participant_id": F.col(participant).cast("string"), "condition": clean, "session_order_numeric": F.coalesce(F.col(order).try_cast("int"), F.lit(1)) if order else F.lit(1)})
    return found.where(F.col("condition").isin(*CONDITIONS))


def condition_rank(c: Column) -> Column:
    """Place of a condition in L, M, H; NULL for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in CONDITIONS]), c), F.lit(0)).cast("int")


def by_condition(df: DataFrame, condition: str, x: str, levels: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """rank, condition, n, mean, sem for each level in their order, also for those without rows."""
    spark = df.sparkSession
    order = spark.createDataFrame([(i, c) for i, c in enumerate(levels, 1)], "rank int, condition string")
    found = df.groupBy(F.col(condition).alias("condition")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double"))).alias("sem"))
    return order.join(found, "condition", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def session_of(df: DataFrame, conditions: DataFrame) -> DataFrame:
    """``df`` (participant, condition, ...) with the trial in which its participant had that condition, NULL if none; the first of several."""
    first = conditions.groupBy("participant", "condition").agg(F.min("trial").alias("trial"))
    return df.join(first, ["participant", "condition"], "left")


def condition_orders(info: DataFrame, participant: str, sessions: list[str]) -> DataFrame:
    """participant, condition_order: the sessions' codes joined, where they make one letter each; those with ``-`` go."""
    order = F.concat_ws("", *[F.trim(F.coalesce(F.col(f"`{s}`").cast("string"), F.lit(""))) for s in sessions])
    found = info.select(F.trim(F.col(f"`{participant}`").cast("string")).alias("participant"), order.alias("condition_order"))
    return found.where((F.length("condition_order") == len(sessions)) & ~F.col("condition_order").contains("-"))


def linear_metrics(df: DataFrame, keys: list[str], x: str, order: list[str], rate: float = 1.0) -> DataFrame:
    """n, mean |velocity|, mean |acceleration| and the root mean square deviation of ``x`` for each key, by first differences."""
    part = Window.partitionBy(*keys).orderBy(*order)
    moved = df.withColumn("__v", (F.col(x) - F.lag(x).over(part)) * rate)
    moved = moved.withColumn("__a", (F.col("__v") - F.lag("__v").over(part)) * rate)
    return moved.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(F.abs("__v")).alias("mean_abs_vel"), F.avg(F.abs("__a")).alias("mean_abs_acc"), F.stddev_pop(x).alias("rms_dev"))


def event_metrics(windows: DataFrame, intervals: DataFrame, key: str, prefix: str, bucket: float) -> DataFrame:
    """``windows`` (key, window_index, first, last) with ``<prefix>_count``, ``_mean_dur`` and ``_rate`` of the intervals (key, start, end) that start within them.

    Both ends count. The rate is per unit of time from the first to the last sample, NULL where they are one.
    """
    cut = windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))))
    starts = intervals.select(F.col(key).alias("__k"), F.col("start").alias("__s"), (F.col("end") - F.col("start")).alias("__d"), F.floor(F.col("start") / bucket).alias("__sb"))
    met = cut.join(starts, (cut[key] == starts["__k"]) & (cut["__b"] == starts["__sb"]) & starts["__s"].between(cut["first"], cut["last"]))
    found = met.groupBy(key, "window_index").agg(F.count("*").alias("__n"), F.avg("__d").alias("__m"))
    n = F.coalesce("__n", F.lit(0))
    joined = windows.join(found, [key, "window_index"], "left")
    return joined.withColumns({f"{prefix}_count": n, f"{prefix}_mean_dur": F.coalesce("__m", F.lit(0.0)), f"{prefix}_rate": F.try_divide(n.cast("double"), F.col("last") - F.col("first"))}).drop("__n", "__m")


def masked_interocular(x1: Column, y1: Column, c1: Column, x2: Column, y2: Column, c2: Column, threshold: float) -> Column:
    """Distance of two landmarks; NULL where either's confidence is below the threshold."""
    low = F.coalesce(c1 < threshold, F.lit(False)) | F.coalesce(c2 < threshold, F.lit(False))
    return F.when(~low, F.hypot(x1 - x2, y1 - y2))


def scaled_gaze(df: DataFrame, axes: dict[str, float]) -> DataFrame:
    """Each column of ``axes`` divided by its screen size, as ``<column> Norm`` beside it."""
    return df.withColumns({f"{c} Norm": F.col(f"`{c}`") / size for c, size in axes.items()})


def first_seconds(df: DataFrame, frame: str, rate: float, seconds: float) -> DataFrame:
    """Rows of the first seconds of each recording, by frame."""
    return df.where(F.col(frame) < int(rate * seconds))


def asymmetry(rr: DataFrame, keys: list[str]) -> DataFrame:
    """Asymmetry and fragmentation of intervals (``rr``, ``drr`` as from ``rr_intervals``, ``place`` their order) for each key.

    Pairs of successive intervals are points; those above the line of identity are decelerations (d), those below
    accelerations (a). Shares are in percent. Porta and Guzik indices, the contributions of both sides to the short-term
    (sd1) and long-term (sd2) spread, and the share of inflection points (Costa et al. 2017).
    """
    part = Window.partitionBy(*keys).orderBy("place")
    d = F.col("drr")
    mean = F.avg("rr").over(Window.partitionBy(*keys))
    points = rr.withColumns({"__turn": F.lead("drr").over(part) * d, "__along": F.col("rr") + F.lag("rr").over(part) - 2 * mean})
    up, down, level = d > 0, d < 0, d == 0
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    n = F.count(d).cast("double")
    square, long_ = d * d, F.col("__along") * F.col("__along")
    side = lambda cond: F.when(cond, long_).when(level, long_ / 2)
    sums = points.groupBy(*keys).agg(
        n.alias("n"), F.count_if(up).alias("up"), F.count_if(down).alias("down"), total(F.when(up, square)).alias("d1"), total(F.when(down, square)).alias("a1"),
        total(side(up)).alias("d2"), total(side(down)).alias("a2"), F.count_if(F.col("__turn") < 0).alias("turns"), F.count("__turn").alias("neighbours"),
    )
    c, pct = F.col, lambda a, b: F.try_divide(100.0 * a, b.cast("double"))
    return sums.where("n > 0").select(
        *keys, c("n").cast("long").alias("n"), pct(c("turns"), c("neighbours")).alias("hrv_pip"), pct(c("down"), c("up") + c("down")).alias("hrv_pi"), pct(c("d1"), c("d1") + c("a1")).alias("hrv_gi"),
        F.sqrt(c("d1") / (2 * c("n"))).alias("hrv_sd1d"), F.sqrt(c("a1") / (2 * c("n"))).alias("hrv_sd1a"), F.sqrt(c("d2") / (2 * c("n"))).alias("hrv_sd2d"), F.sqrt(c("a2") / (2 * c("n"))).alias("hrv_sd2a"),
        pct(c("d2"), c("d2") + c("a2")).alias("hrv_c2d"), pct(c("a2"), c("d2") + c("a2")).alias("hrv_c2a"), pct(c("a1"), c("d1") + c("a1")).alias("hrv_c1a"),
        F.sqrt((c("d1") + c("d2")) / (4 * c("n"))).alias("hrv_sdnnd"), F.sqrt((c("a1") + c("a2")) / (4 * c("n"))).alias("hrv_sdnna"),
    )
