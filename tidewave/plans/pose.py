"""Queries of frame metrics: each vector's 64 numbers are taken as landmarks of a frame, its label as the recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calculus, pose, windows
from .tables import rounded, table

Q = {}
SQL = {}

#: A point whose x is this close to 0 counts as lost.
LOST = 0.004


def query(f):
    Q[f.__name__] = f
    return f


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def at(k: int, axis: int):
        x = F.try_element_at("embedding", F.lit(2 * k + 1)).cast("double")
        return F.when(F.abs(x) >= LOST, x if not axis else F.try_element_at("embedding", F.lit(2 * k + 2)).cast("double"))

    points = [at(k, axis).alias(f"{name}{i}") for k, i in enumerate(pose.RELEVANT) for axis, name in enumerate("xy")]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *points)


IDS = ", ".join(map(str, pose.RELEVANT))
LONG = f"""k AS (SELECT unnest([{IDS}]) AS i, unnest(range(0, {len(pose.RELEVANT)})) AS k),
f AS (SELECT vec_id, label, i, CASE WHEN abs(embedding[2 * k + 1]::DOUBLE) >= {LOST} THEN embedding[2 * k + 1]::DOUBLE END AS x, CASE WHEN abs(embedding[2 * k + 1]::DOUBLE) >= {LOST} THEN embedding[2 * k + 2]::DOUBLE END AS y FROM embeddings, k)"""


def _eyes(rows: str, least: int, vertical: bool) -> str:
    """A table of eye metrics from rows vec_id, i, x, y."""
    sides = {s: ", ".join(map(str, ring)) for s, (_, _, ring, _) in pose.EYES.items()}
    cells = []
    for s, (top, low, _, pupil) in pose.EYES.items():
        mid = lambda pair, a: f"(max({a}) FILTER (i = {pair[0]}) + max({a}) FILTER (i = {pair[1]})) / 2"
        dy = f"({mid(top, 'y')}) - ({mid(low, 'y')})"
        cells.append((f"abs({dy})" if vertical else f"sqrt(pow({dy}, 2) + pow(({mid(top, 'x')}) - ({mid(low, 'x')}), 2))") + f" AS lid_{s}")
        for a in "xy":
            cells.append(f"max({a}) FILTER (i = {pupil}) - CASE WHEN count({a}) FILTER (i IN ({sides[s]})) >= {least} THEN avg({a}) FILTER (i IN ({sides[s]})) END AS d{a}_{s}")
    p, q = pose.LIPS
    mouth = f"sqrt(pow(max(x) FILTER (i = {q}) - max(x) FILTER (i = {p}), 2) + pow(max(y) FILTER (i = {q}) - max(y) FILTER (i = {p}), 2)) AS mouth_aperture"
    either = lambda a, b: f"round(CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE ({a} + {b}) / 2 END, 5) + 0.0"
    size = lambda s: f"sqrt(dx_{s} * dx_{s} + dy_{s} * dy_{s})"
    return f"""SELECT vec_id, {either("lid_left", "lid_right")} AS blink_aperture, round(mouth_aperture, 5) AS mouth_aperture, {either("dx_left", "dx_right")} AS pupil_dx, {either("dy_left", "dy_right")} AS pupil_dy, {either(size("left"), size("right"))} AS pupil_metric
 FROM (SELECT vec_id, {", ".join(cells)}, {mouth} FROM {rows} GROUP BY vec_id)"""


@query
def pose_frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine metrics of each frame from the points as they are."""
    found = pose.original_metrics(frames(spark, sf_dir), ["label"])
    return rounded(found.select("vec_id", *pose.ORIGINAL), *pose.ORIGINAL, places=5)


CENTRE_IDS = ", ".join(map(str, pose.CENTRE))
A, B = pose.CORNERS
SQL["pose_frame_metrics"] = f"""WITH {LONG}, d AS (SELECT vec_id, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM f WHERE i IN ({CENTRE_IDS}) WINDOW w AS (PARTITION BY label, i)),
c AS (SELECT vec_id, round(sqrt(avg(dx * dx + dy * dy)), 5) AS center_face_magnitude, round(sqrt(avg(dx * dx)), 5) AS center_face_x, round(sqrt(avg(dy * dy)), 5) AS center_face_y FROM d GROUP BY 1),
h AS (SELECT vec_id, round(atan2(max(y) FILTER (i = {B}) - max(y) FILTER (i = {A}), max(x) FILTER (i = {B}) - max(x) FILTER (i = {A})), 5) + 0.0 AS head_rotation_rad FROM f GROUP BY 1)
SELECT * FROM h JOIN c USING (vec_id) JOIN ({_eyes("f", 1, True)}) USING (vec_id)"""


def _aligned_sql(by: str) -> str:
    on = "f.label = m.label AND f.i = m.i" if by else "f.i = m.i"
    return f"""WITH {LONG}, m AS (SELECT {by}i, avg(x) AS u, avg(y) AS v FROM f GROUP BY ALL),
p AS (SELECT f.vec_id, x, y, u, v FROM f JOIN m ON {on} WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT vec_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS tx, avg(v) AS ty, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy, var_pop(y) * count(*) AS yy, covar_pop(x, u) * count(*) AS b00, covar_pop(x, v) * count(*) AS b01, covar_pop(y, u) * count(*) AS b10, covar_pop(y, v) * count(*) AS b11 FROM p GROUP BY 1),
a AS (SELECT *, (yy * b00 - xy * b10) / d AS a00, (yy * b01 - xy * b11) / d AS a01, (xx * b10 - xy * b00) / d AS a10, (xx * b11 - xy * b01) / d AS a11 FROM (SELECT *, xx * yy - xy * xy AS d FROM s) WHERE n >= 3 AND abs(d) > 1e-12),
t AS (SELECT *, CASE WHEN a00 * a11 - a01 * a10 >= 0 THEN 1.0::DOUBLE ELSE -1.0 END AS f FROM a),
r AS (SELECT *, atan2(a10 - f * a01, a00 + f * a11) AS theta FROM t),
c AS (SELECT *, cos(theta) * a00 + sin(theta) * a10 AS sx, -f * sin(theta) * a01 + f * cos(theta) * a11 AS sy FROM r),
z AS (SELECT *, tx - (mx * cos(theta) + my * sin(theta)) * sx AS hx, ty - f * (my * cos(theta) - mx * sin(theta)) * sy AS hy FROM c),
g AS (SELECT f.vec_id, f.i, (x * cos(theta) + y * sin(theta)) * sx + hx AS x, z.f * (y * cos(theta) - x * sin(theta)) * sy + hy AS y FROM f LEFT JOIN z ON f.vec_id = z.vec_id)
SELECT e.*, round(theta, 5) + 0.0 AS head_rotation_rad, round(hx, 5) + 0.0 AS head_tx, round(hy, 5) + 0.0 AS head_ty, round(sx, 5) + 0.0 AS head_scalex, round(sy, 5) + 0.0 AS head_scaley, round(sqrt(hx * hx + hy * hy + (sx - 1) * (sx - 1) + (sy - 1) * (sy - 1)), 5) AS head_motion_mag
FROM ({_eyes("g", 3, False)}) e LEFT JOIN z USING (vec_id)"""


@query
def pose_aligned_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven metrics of each frame carried onto the mean of all frames."""
    f = frames(spark, sf_dir)
    return rounded(pose.aligned_metrics(f, pose.means(f, [], pose.RELEVANT, "__t"), []).select("vec_id", *pose.ALIGNED), *pose.ALIGNED, places=5)


@query
def pose_aligned_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same onto the mean of the recording's frames."""
    f = frames(spark, sf_dir)
    return rounded(pose.aligned_metrics(f, pose.means(f, ["label"], pose.RELEVANT, "__t"), ["label"]).select("vec_id", *pose.ALIGNED), *pose.ALIGNED, places=5)


SQL["pose_aligned_global"] = _aligned_sql("")
SQL["pose_aligned_participant"] = _aligned_sql("label, ")


@query
def pose_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame metrics, their derivatives, lengths in units of the distance between the eyes, and statistics of windows of 20 frames every 10."""
    f = frames(spark, sf_dir).withColumn("interocular", pose.interocular())
    metrics = calculus.derivatives(pose.original_metrics(f, ["label"]).select("label", "vec_id", "interocular", "mouth_aperture"), "mouth_aperture", ["label"], ["vec_id"], 60.0)
    scaled = pose.in_eye_distances(metrics, ("mouth_aperture", "mouth_aperture_vel", "mouth_aperture_acc"))
    dealt = windows.by_count(scaled, ["label"], ["vec_id"], 20, 10)
    names = ("mouth_aperture", "mouth_aperture_vel")
    found = dealt.groupBy("label", "window_index").agg(*[e.alias(f"{m}_{k}") for m in names for k, e in (("n", F.count(m)), ("mean", F.avg(m)), ("rms", F.sqrt(F.avg(F.col(m) * F.col(m)))))])
    return rounded(found, *[f"{m}_{k}" for m in names for k in ("mean", "rms")], places=4)


P, R = pose.LIPS
SQL["pose_window_features"] = f"""WITH {LONG}, w AS (SELECT label, vec_id, sqrt(pow(max(x) FILTER (i = {R}) - max(x) FILTER (i = {P}), 2) + pow(max(y) FILTER (i = {R}) - max(y) FILTER (i = {P}), 2)) AS m,
 sqrt(pow(max(x) FILTER (i = {B}) - max(x) FILTER (i = {A}), 2) + pow(max(y) FILTER (i = {B}) - max(y) FILTER (i = {A}), 2)) AS io FROM f GROUP BY ALL),
v AS (SELECT *, row_number() OVER q - 1 AS r, count(*) OVER (PARTITION BY label) AS n, CASE WHEN row_number() OVER q = 1 THEN lead(m) OVER q - m WHEN lead(1) OVER q IS NULL THEN m - lag(m) OVER q ELSE (lead(m) OVER q - lag(m) OVER q) / 2 END * 60 AS vel FROM w WINDOW q AS (PARTITION BY label ORDER BY vec_id)),
z AS (SELECT label, r, n, CASE WHEN io >= 1e-6 THEN m / io ELSE m END AS m, CASE WHEN io >= 1e-6 THEN vel / io ELSE vel END AS vel FROM v),
d AS (SELECT *, unnest(range(greatest(0, ceil((r - 19) / 10.0))::BIGINT, r // 10 + 1))::INT AS window_index FROM z)
SELECT label, window_index, count(m) AS mouth_aperture_n, round(avg(m), 4) AS mouth_aperture_mean, round(sqrt(avg(m * m)), 4) AS mouth_aperture_rms, count(vel) AS mouth_aperture_vel_n, round(avg(vel), 4) + 0.0 AS mouth_aperture_vel_mean, round(sqrt(avg(vel * vel)), 4) AS mouth_aperture_vel_rms FROM d WHERE window_index * 10 + 20 <= n GROUP BY ALL"""
