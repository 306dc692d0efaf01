"""Metrics of each frame from facial landmarks in columns ``x<i>``, ``y<i>``; NULL is a lost point.

All sums over landmarks are within a row, so frames aren't shuffled; only the means of a template or of a recording's
landmarks are aggregates, of a row for each key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import row_mean
from ..functions.geometry import Point, angle, distance, scaled_by, solved

# The landmark scheme of the recordings.
RELEVANT = (*range(28, 40), 41, 42, *range(44, 49), 63, 67, 69, 70)
CENTRE = tuple(range(28, 37))
CORNERS = (37, 46)
LIPS = (63, 67)
EYES = {"left": ((38, 39), (41, 42), (37, 38, 39, 41, 42), 69), "right": ((44, 45), (47, 48), (44, 45, 46, 47, 48), 70)}

ALIGNED = ("head_rotation_rad", "head_tx", "head_ty", "head_scalex", "head_scaley", "head_motion_mag", "blink_aperture", "mouth_aperture", "pupil_dx", "pupil_dy", "pupil_metric")
ORIGINAL = ("head_rotation_rad", "blink_aperture", "mouth_aperture", "pupil_dx", "pupil_dy", "pupil_metric", "center_face_magnitude", "center_face_x", "center_face_y")
#: Metrics without a unit of length stay as they are when lengths are put in units of the distance between the eyes.
UNITLESS = ("head_rotation_rad", "head_scalex", "head_scaley")


def point(i: int) -> Point:
    return F.col(f"x{i}"), F.col(f"y{i}")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def interocular() -> Column:
    return distance(point(CORNERS[0]), point(CORNERS[1]))


def means(df: DataFrame, keys: list[str], landmarks: tuple[int, ...], prefix: str) -> DataFrame:
    """One row a key with the mean place of each landmark, lost points aside: ``<prefix>x<i>``, ``<prefix>y<i>``."""
    return df.groupBy(*keys).agg(*[F.avg(f"{a}{i}").alias(f"{prefix}{a}{i}") for i in landmarks for a in "xy"])


def centre(points: list[Point], least: int = 1) -> Point:
    """Mean of the points that aren't lost, NULL if they are fewer than ``least``."""
    seen = total([F.when(p[0].isNotNull() & p[1].isNotNull(), 1).otherwise(0) for p in points])
    return tuple(F.when(seen >= least, row_mean(*[p[a] for p in points])) for a in (0, 1))


def middle(p: Point, q: Point) -> Point:
    return (p[0] + q[0]) / 2, (p[1] + q[1]) / 2


def eye_metrics(at: dict[int, Point], ring_least: int, opening) -> dict[str, Column]:
    """Means over the eyes that can be seen. opening: of an eye, from the middle of the upper lid and that of the lower."""
    lids, dx, dy, size = [], [], [], []
    for top, low, ring, pupil in EYES.values():
        lids.append(opening(middle(*[at[i] for i in top]), middle(*[at[i] for i in low])))
        c = centre([at[i] for i in ring], ring_least)
        dx.append(at[pupil][0] - c[0])
        dy.append(at[pupil][1] - c[1])
        size.append(F.hypot(dx[-1], dy[-1]))
    return {"blink_aperture": row_mean(*lids), "mouth_aperture": distance(at[LIPS[0]], at[LIPS[1]]), "pupil_dx": row_mean(*dx), "pupil_dy": row_mean(*dy), "pupil_metric": row_mean(*size)}


def original_metrics(df: DataFrame, recording: list[str]) -> DataFrame:
    """The nine metrics of ORIGINAL from the points as they are; the lids' opening is vertical.

    The centre of the face is measured against each landmark's mean over its recording, which comes back by a join of
    one row a recording: a long recording isn't held in one window.
    """
    at = {i: point(i) for i in RELEVANT}
    framed = df.join(means(df, recording, CENTRE, "__m"), recording)
    off = {i: (F.col(f"x{i}") - F.col(f"__mx{i}"), F.col(f"y{i}") - F.col(f"__my{i}")) for i in CENTRE}
    spread = lambda f: F.sqrt(row_mean(*[f(*off[i]) for i in CENTRE]))
    found = {
        "head_rotation_rad": angle(point(CORNERS[0]), point(CORNERS[1])), **eye_metrics(at, 1, lambda top, low: F.abs(top[1] - low[1])),
        "center_face_magnitude": spread(lambda x, y: x * x + y * y), "center_face_x": spread(lambda x, y: x * x), "center_face_y": spread(lambda x, y: y * y),
    }
    return framed.withColumns(found).drop(*[f"__m{a}{i}" for i in CENTRE for a in "xy"])


def aligned_metrics(df: DataFrame, templates: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """The eleven metrics of ALIGNED, from each frame carried onto its template (``means`` with the prefix ``__t`` over RELEVANT).

    With ``keys`` each key has its template, joined on them; without, the one template is a row of constants. A frame
    with fewer than ``least`` points, or with points on a line, has NULLs.
    """
    if keys:
        framed = df.join(templates, keys)
        template = {i: (F.col(f"__tx{i}"), F.col(f"__ty{i}")) for i in RELEVANT}
    else:
        one = templates.first()  # two numbers a landmark
        framed, template = df, {i: tuple(F.lit(one[f"__t{a}{i}"]).cast("double") for a in "xy") for i in RELEVANT}
    quads = F.array(*[F.struct(*[c.alias(k) for k, c in zip("xyuv", (*point(i), *template[i]), strict=True)]) for i in RELEVANT])
    framed = framed.withColumn("__q", F.filter(quads, lambda q: q.x.isNotNull() & q.y.isNotNull() & q.u.isNotNull() & q.v.isNotNull()))
    each = lambda f: F.aggregate("__q", F.lit(0.0), lambda a, q: a + f(q))
    mid = {"x": "__mx", "y": "__my", "u": "__tx", "v": "__ty"}
    framed = framed.withColumn("__n", F.size("__q")).withColumns({m: F.try_divide(each(lambda q, k=k: q[k]), F.col("__n")) for k, m in mid.items()})
    products = {"xx": "xx", "xy": "xy", "yy": "yy", "b00": "xu", "b01": "xv", "b10": "yu", "b11": "yv"}
    framed = framed.withColumns({f"__{k}": each(lambda q, a=a, b=b: (q[a] - F.col(mid[a])) * (q[b] - F.col(mid[b]))) for k, (a, b) in products.items()})
    for step in solved(least):
        framed = framed.withColumns(step)
    cos, sin, flip = F.cos("theta"), F.sin("theta"), F.col("__flip")
    moved = {}
    for i in RELEVANT:
        x, y = point(i)
        moved |= {f"__px{i}": (x * cos + y * sin) * F.col("scale_x") + F.col("shift_x"), f"__py{i}": flip * (y * cos - x * sin) * F.col("scale_y") + F.col("shift_y")}
    framed = framed.withColumns(moved)
    at = {i: (F.col(f"__px{i}"), F.col(f"__py{i}")) for i in RELEVANT}
    squares = [F.col("shift_x"), F.col("shift_y"), F.col("scale_x") - 1, F.col("scale_y") - 1]
    found = {
        "head_rotation_rad": F.col("theta"), "head_tx": F.col("shift_x"), "head_ty": F.col("shift_y"), "head_scalex": F.col("scale_x"), "head_scaley": F.col("scale_y"),
        "head_motion_mag": F.sqrt(total([c * c for c in squares])), **eye_metrics(at, 3, distance),
    }
    return framed.withColumns(found).select(*df.columns, *ALIGNED)


def in_eye_distances(df: DataFrame, metrics: tuple[str, ...], unit: str = "interocular") -> DataFrame:
    """Lengths, and what derives from them, in units of the distance between the eyes where that is known and not tiny."""
    return df.withColumns({m: scaled_by(F.col(m), F.col(unit)) for m in metrics if not m.startswith(UNITLESS)})
