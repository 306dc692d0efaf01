"""Queries of beats, their rate and its variability. Events stand for beats; the gaps between a user's events are the intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beats, complexity, physiology, windows
from .series import ORDER, TIME_WINDOWS
from .tables import DAY, EVENTS, events, rounded

Q = {}
SQL = {}
KEYS = ["user_id", "window_index"]


def query(f):
    Q[f.__name__] = f
    return f


def _gaps(spark: SparkSession, sf_dir: str, size: float = 8 * DAY, hop: float = 4 * DAY) -> DataFrame:
    """Gaps in hours, so that a gap of a day is as a beat of 24 ms."""
    dealt = windows.by_time(events(spark, sf_dir), ["user_id"], "t", size, hop)
    return physiology.rr_intervals(dealt.withColumn("t", F.col("t") / 3.6e6), KEYS, "t")


EIGHT = TIME_WINDOWS.replace(f"k * {DAY} <= t AND t < k * {DAY} + {2 * DAY} AND k * {DAY} < last - {2 * DAY} + 1", f"k * {4 * DAY} <= t AND t < k * {4 * DAY} + {8 * DAY} AND k * {4 * DAY} < last - {8 * DAY} + 1")
GAPS = f"""{EIGHT}, r AS (SELECT user_id, window_index, t / 3.6e6 AS t, (t / 3.6e6 - lag(t / 3.6e6) OVER (PARTITION BY user_id, window_index ORDER BY t)) * 1000 AS rr FROM w),
g AS (SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, window_index ORDER BY t) AS drr FROM r)"""


@query
def beat_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by class of beat, a unit of time being an hour: how many of each."""
    e = events(spark, sf_dir).withColumn("h", F.col("t") / 3600)
    return beats.classified(e, ["user_id"], "h", least=500.0).groupBy("user_id", "class").agg(F.count("*").alias("n"))


def _limit(c: str) -> str:
    return f"greatest((quantile_cont(abs({c}), 0.75) OVER wide - quantile_cont(abs({c}), 0.25) OVER wide) / 2 * 5.2, 500)"


SQL["beat_classes"] = f"""WITH {EVENTS}, b AS (SELECT user_id, t / 3600 AS h FROM e), r AS (SELECT *, (h - lag(h) OVER p) * 1000 AS rr FROM b WINDOW p AS (PARTITION BY user_id ORDER BY h)),
d AS (SELECT *, rr - lag(rr) OVER p AS drr, quantile_cont(rr, 0.5) OVER (PARTITION BY user_id ORDER BY h ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM r WINDOW p AS (PARTITION BY user_id ORDER BY h)),
o AS (SELECT *, CASE WHEN rr - med < 0 THEN 2 * (rr - med) ELSE rr - med END AS off FROM d),
s AS (SELECT *, drr / {_limit("drr")} AS d, {_limit("off")} AS lim FROM o WINDOW wide AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING)),
k AS (SELECT *, lead(d, 1) OVER p AS d1, lead(d, 2) OVER p AS d2, lead(rr) OVER p AS rr1 FROM s WINDOW p AS (PARTITION BY user_id ORDER BY h)),
f AS (SELECT *, (d1 > 1 AND greatest(d, d2) < -0.13 * d1 - 0.17) OR (d1 < -1 AND least(d, d2) > -0.13 * d1 + 0.17) AS ectopic, (d > 1 AND least(d1, d2) < -1) OR (d < -1 AND greatest(d1, d2) > 1) OR abs(off) > 3 * lim AS odd FROM k)
SELECT user_id, CASE WHEN ectopic THEN 'ectopic' WHEN odd AND abs(rr / 2 - med) < lim THEN 'missed' WHEN odd AND abs(rr + rr1 - med) < lim THEN 'extra' WHEN odd AND off > 0 THEN 'long' WHEN odd THEN 'short' ELSE 'normal' END AS class, count(*) AS n FROM f GROUP BY ALL"""


@query
def beats_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each user's events stay, move or come in when beats are repaired; the tests plant missed, extra and shifted beats."""
    e = events(spark, sf_dir).withColumn("h", F.col("t") / 3600)
    return beats.repaired(e, ["user_id"], "h").groupBy("user_id", "status").agg(F.count("*").alias("n"))


@query
def rate_monotone_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values every six hours, on a monotone cubic through the events."""
    points = events(spark, sf_dir).groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    return rounded(beats.monotone_cubic(points, ["user_id"], "t", "value", DAY / 4), "y", places=5)


def _end(h0: str, h1: str, s0: str, s1: str) -> str:
    slope = f"(((2 * {h0} + {h1}) * {s0} - {h0} * {s1}) / ({h0} + {h1}))"
    return f"CASE WHEN {s1} IS NULL THEN {s0} WHEN {slope} * {s0} <= 0 THEN 0.0 WHEN {s0} * {s1} <= 0 AND abs({slope}) > 3 * abs({s0}) THEN 3 * {s0} ELSE {slope} END"


SQL["rate_monotone_cubic"] = f"""WITH {EVENTS}, p AS (SELECT user_id, t, avg(value) AS y FROM e WHERE value IS NOT NULL GROUP BY 1, 2),
a AS (SELECT *, lead(t) OVER q - t AS h, (lead(y) OVER q - y) / (lead(t) OVER q - t) AS s FROM p WINDOW q AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT *, lag(h) OVER q AS hp, lag(s) OVER q AS sp, lag(h, 2) OVER q AS hpp, lag(s, 2) OVER q AS spp, lead(h) OVER q AS hn, lead(s) OVER q AS sn FROM a WINDOW q AS (PARTITION BY user_id ORDER BY t)),
m AS (SELECT *, CASE WHEN sp IS NULL THEN {_end("h", "hn", "s", "sn")} WHEN s IS NULL THEN {_end("hp", "hpp", "sp", "spp")} WHEN sp * s <= 0 THEN 0.0 ELSE (3 * h + 3 * hp) / ((2 * h + hp) / sp + (h + 2 * hp) / s) END AS m FROM b),
c AS (SELECT *, lead(m) OVER q AS m1, lead(y) OVER q AS y1, lead(t) OVER q AS t1, lead(t, 2) OVER q IS NULL AS fin FROM m WINDOW q AS (PARTITION BY user_id ORDER BY t)),
n AS (SELECT *, unnest(range(ceil(t / {DAY / 4})::BIGINT, CASE WHEN fin THEN floor(t1 / {DAY / 4})::BIGINT + 1 ELSE ceil(t1 / {DAY / 4})::BIGINT END)) AS n FROM c WHERE t1 IS NOT NULL),
u AS (SELECT *, (n * {DAY / 4} - t) / h AS u FROM n)
SELECT user_id, n, n * {DAY / 4} AS t, round((2 * u ** 3 - 3 * u ** 2 + 1) * y + (u ** 3 - 2 * u ** 2 + u) * h * m + (3 * u ** 2 - 2 * u ** 3) * y1 + (u ** 3 - u ** 2) * h * m1, 5) AS y FROM u"""


@query
def rate_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged periodograms of those samples in segments of eight days, as powers of slow bands; the tests hold them against a plain form."""
    points = events(spark, sf_dir).groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    samples = beats.monotone_cubic(points, ["user_id"], "t", "value", DAY / 4)
    lines = beats.welch(samples, ["user_id"], ["n"], "y", 4.0, 32)  # in cycles a day
    return beats.band_powers(lines, ["user_id"], 4.0 / 32, {"vlf": (0.0, 0.3), "lf": (0.3, 0.8), "hf": (0.8, 2.01)})


@query
def beat_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the values around each purchase lie from the mean course around the user's purchases."""
    framed = windows.by_count(events(spark, sf_dir), ["user_id"], ORDER, 1, 1)
    found = beats.averaged_beat(framed, framed.where("event_type = 'purchase'").select("user_id", "frame"), ["user_id"], "value", 2, 2)
    return rounded(found, "distance", "quality", places=5)


SQL["beat_shapes"] = f"""WITH {EVENTS}, f AS (SELECT user_id, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1)::INT AS frame FROM e),
x AS (SELECT b.user_id, b.frame AS beat, s.frame - b.frame AS place, s.value FROM f b JOIN f s ON s.user_id = b.user_id AND s.frame BETWEEN b.frame - 2 AND b.frame + 2 WHERE b.event_type = 'purchase'),
d AS (SELECT user_id, beat AS frame, sqrt(sum((value - mean) ** 2)) AS distance FROM (SELECT *, avg(value) OVER (PARTITION BY user_id, place) AS mean FROM x) GROUP BY 1, 2)
SELECT user_id, frame, round(distance, 5) AS distance, round(1 - coalesce(distance / nullif(max(distance) OVER (PARTITION BY user_id), 0), 0), 5) AS quality FROM d"""


@query
def hrv_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beats.hrv_more(_gaps(spark, sf_dir), KEYS)
    return rounded(found, *[c for c in found.columns if c.startswith("hrv_")], places=4)


SQL["hrv_more"] = f"""WITH {GAPS}, k AS (SELECT * FROM g WHERE rr IS NOT NULL),
m AS (SELECT user_id, window_index, median(rr) AS med, avg(rr) AS mean, stddev_samp(rr) AS sdnn, sqrt(avg(drr * drr)) AS rmssd, stddev_samp(drr) AS sdsd, count(*) AS n_rr, quantile_cont(rr, 0.2) AS p20, quantile_cont(rr, 0.8) AS p80 FROM k GROUP BY 1, 2),
o AS (SELECT k.user_id, k.window_index, median(abs(rr - med)) * 1.4826 AS mad FROM k JOIN m USING (user_id, window_index) GROUP BY 1, 2),
b AS (SELECT user_id, window_index, max(n) AS top FROM (SELECT user_id, window_index, floor(rr / 7.8125) AS bin, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1, 2),
s AS (SELECT *, sdsd / sqrt(2) AS sd1, sqrt(greatest(2 * sdnn * sdnn - sdsd * sdsd / 2, 0)) AS sd2 FROM m JOIN o USING (user_id, window_index) JOIN b USING (user_id, window_index))
SELECT user_id, window_index, n_rr, round(rmssd / nullif(mean, 0), 4) AS hrv_cvsd, round(sdnn / nullif(rmssd, 0), 4) AS hrv_sdrmssd, round(mad, 4) AS hrv_madnn, round(mad / nullif(med, 0), 4) AS hrv_mcvnn, round(p20, 4) AS hrv_prc20nn, round(p80, 4) AS hrv_prc80nn, round(n_rr / top, 4) AS hrv_hti,
 round(sd1 * sd2 * pi(), 4) AS hrv_s, round(sd2 / nullif(sd1, 0), 4) AS hrv_csi, round(CASE WHEN sd1 > 0 AND sd2 > 0 THEN log10(16 * sd1 * sd2) END, 4) AS hrv_cvi, round(4 * sd2 * sd2 / nullif(sd1, 0), 4) AS hrv_csi_modified FROM s"""


@query
def hrv_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beats.hrv_fragments(_gaps(spark, sf_dir), KEYS, "t")
    return rounded(found, *[c for c in found.columns if c.startswith("hrv_")], places=4)


SQL["hrv_fragments"] = f"""WITH {GAPS}, c AS (SELECT *, abs(atan2(rr, rr - drr) - pi() / 4) AS angle, sign(drr) AS s, 2 * rr - drr - 2 * avg(rr) OVER (PARTITION BY user_id, window_index) AS along FROM g WHERE rr IS NOT NULL),
d AS (SELECT *, angle * (rr * rr + (rr - drr) * (rr - drr)) / 2 AS area, row_number() OVER k AS i, lag(s) OVER k AS b FROM c WHERE drr IS NOT NULL WINDOW k AS (PARTITION BY user_id, window_index ORDER BY t)),
n AS (SELECT *, sum(CASE WHEN s = b THEN 0 ELSE 1 END) OVER k AS run, sum(CASE WHEN s * b < 0 THEN 0 ELSE 1 END) OVER k AS alt FROM d WINDOW k AS (PARTITION BY user_id, window_index ORDER BY t)),
ru AS (SELECT user_id, window_index, count(*) AS runs, sum(n) AS within, coalesce(sum(n) FILTER (n >= 3), 0) AS long FROM (SELECT user_id, window_index, run, count(*) AS n FROM n WHERE s <> 0 GROUP BY ALL) GROUP BY 1, 2),
tu AS (SELECT user_id, window_index, coalesce(sum(n) FILTER (n >= 4), 0) AS turns FROM (SELECT user_id, window_index, alt, count(*) AS n FROM n GROUP BY ALL) GROUP BY 1, 2),
a AS (SELECT user_id, window_index, count(*) AS n, sum(CASE WHEN s > 0 THEN angle ELSE 0 END) AS g1, sum(CASE WHEN s < 0 THEN angle ELSE 0 END) AS g2, sum(CASE WHEN s > 0 THEN area ELSE 0 END) AS r1, sum(CASE WHEN s < 0 THEN area ELSE 0 END) AS r2, sum(CASE WHEN s > 0 THEN drr * drr ELSE 0 END) AS v1, sum(CASE WHEN s < 0 THEN drr * drr ELSE 0 END) AS v2,
 sum(CASE WHEN s > 0 THEN drr * drr + along * along WHEN s = 0 THEN along * along / 2 ELSE 0 END) AS h1, sum(CASE WHEN s < 0 THEN drr * drr + along * along WHEN s = 0 THEN along * along / 2 ELSE 0 END) AS h2 FROM n GROUP BY 1, 2)
SELECT user_id, window_index, n, round(100 * g1 / nullif(g1 + g2, 0), 4) AS hrv_si, round(100 * r1 / nullif(r1 + r2, 0), 4) AS hrv_ai, round(100 * v1 / nullif(v1 + v2, 0), 4) AS hrv_c1d, round(100 * h1 / nullif(h1 + h2, 0), 4) AS hrv_cd, round(100 * h2 / nullif(h1 + h2, 0), 4) AS hrv_ca,
 round(runs / within, 4) AS hrv_ials, round(100 - 100.0 * coalesce(long, 0) / n, 4) AS hrv_pss, round(100.0 * coalesce(turns, 0) / n, 4) AS hrv_pas FROM a LEFT JOIN ru USING (user_id, window_index) LEFT JOIN tu USING (user_id, window_index)"""


@query
def hrv_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(complexity.hrv_symbols(_gaps(spark, sf_dir), KEYS, "t", 6.0), "hrv_shanen", "hrv_permen", places=5)


_ENTROPY = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"
SQL["hrv_symbols"] = f"""WITH {GAPS}, k AS (SELECT *, lead(rr, 1) OVER q AS r1, lead(rr, 2) OVER q AS r2 FROM g WHERE rr IS NOT NULL WINDOW q AS (PARTITION BY user_id, window_index ORDER BY t)),
s AS (SELECT user_id, window_index, {_ENTROPY} AS sh FROM (SELECT user_id, window_index, round(rr / 6) AS v, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1, 2),
p AS (SELECT user_id, window_index, ({_ENTROPY}) / log2(6) AS pe FROM (SELECT user_id, window_index, rr <= r1 AS a, r1 <= r2 AS b, rr <= r2 AS c, count(*) AS n FROM k WHERE r2 IS NOT NULL GROUP BY ALL) GROUP BY 1, 2)
SELECT user_id, window_index, round(sh, 5) AS hrv_shanen, round(pe, 5) AS hrv_permen FROM s LEFT JOIN p USING (user_id, window_index)"""


@query
def hrv_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higuchi's and Katz's dimensions of the gaps."""
    return rounded(complexity.hrv_curves(_gaps(spark, sf_dir), KEYS, "t", 4), "hrv_hfd", "hrv_kfd", places=5)


SQL["hrv_curves"] = f"""WITH {GAPS}, k AS (SELECT user_id, window_index, t, rr AS x, row_number() OVER q - 1 AS i, count(*) OVER (PARTITION BY user_id, window_index) AS n, first_value(rr) OVER q AS f, lag(rr) OVER q AS b FROM g WHERE rr IS NOT NULL WINDOW q AS (PARTITION BY user_id, window_index ORDER BY t)),
ka AS (SELECT user_id, window_index, count(*) AS n_rr, CASE WHEN count(*) > 2 AND max(abs(x - f)) > 0 THEN ln(count(*) - 1) / (ln(count(*) - 1) + ln(max(abs(x - f)) / sum(abs(x - b)))) END AS kfd FROM k GROUP BY 1, 2),
s AS (SELECT k.*, step, abs(x - lag(x) OVER (PARTITION BY user_id, window_index, step, i % step ORDER BY i)) AS d FROM k, range(1, 5) r(step) WHERE n >= 8),
le AS (SELECT user_id, window_index, step, i % step AS m, sum(d) * (any_value(n) - 1) / count(d) / step / step AS l FROM s GROUP BY user_id, window_index, step, i % step),
h AS (SELECT user_id, window_index, step, avg(l) AS l FROM le GROUP BY ALL HAVING avg(l) > 0),
hi AS (SELECT user_id, window_index, CASE WHEN count(*) = 4 THEN regr_slope(ln(l), -ln(step)) END AS hfd FROM h GROUP BY 1, 2)
SELECT user_id, window_index, n_rr, round(hfd, 5) AS hrv_hfd, round(kfd, 5) AS hrv_kfd FROM ka LEFT JOIN hi USING (user_id, window_index)"""


@query
def hrv_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies, dimensions and exponents of the gaps in twenty-day windows; the tests hold each column against a plain form."""
    return complexity.hrv_complexity(_gaps(spark, sf_dir, 20 * DAY, 10 * DAY), KEYS, "t")


@query
def ecg_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values without slow drift, recordings cut into slices of a day; the tests hold it against the plain form."""
    return beats.cleaned(events(spark, sf_dir), "user_id", ORDER, "value", rate=10.0, drift=0.5, mains=5.0, width=DAY)
