"""Landmark geometry as expressions: screen scaling, distances, angles, and alignment to a template in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def distance(p: Point, q: Point) -> Column:
    return F.hypot(p[0] - q[0], p[1] - q[1])


def angle(p: Point, q: Point) -> Column:
    """Direction from p to q in radians."""
    return F.atan2(q[1] - p[1], q[0] - p[0])


def to_screen(p: Point, width: float, height: float) -> Point:
    return p[0] / F.lit(float(width)), p[1] / F.lit(float(height))


def scaled_by(value: Column, unit: Column, least: float = 1e-6) -> Column:
    """``value`` in units of ``unit`` where that is known and not tiny, else as it is."""
    return F.when(unit.isNotNull() & (F.abs(unit) >= least), value / unit).otherwise(value)


def alignment_sums() -> list[Column]:
    """Aggregates over rows x, y (a point) and u, v (its place in the template): all that ``solved`` needs."""
    n = F.count("*")
    second = {"xx": ("x", "x"), "xy": ("x", "y"), "yy": ("y", "y"), "b00": ("x", "u"), "b01": ("x", "v"), "b10": ("y", "u"), "b11": ("y", "v")}
    means = {"mx": "x", "my": "y", "tx": "u", "ty": "v"}
    return [n.alias("__n"), *[F.avg(c).alias(f"__{k}") for k, c in means.items()], *[(F.covar_pop(p, q) * n).alias(f"__{k}") for k, (p, q) in second.items()]]


def solved(least: int = 3, tiny: float = 1e-12) -> list[dict[str, Column]]:
    """theta, scale_x, scale_y, shift_x, shift_y that carry a shape onto its template, as steps of ``withColumns`` on ``alignment_sums``.

    A centred least-squares map, split into a rotation (its polar factor, for 2 by 2 a single angle) and stretches along
    the axes. NULL for fewer than ``least`` pairs or points on a line. The rotation is applied to rows, in the
    convention of the fit.
    """
    c = F.col
    d = c("__xx") * c("__yy") - c("__xy") * c("__xy")
    fits = (c("__n") >= least) & (F.abs(d) > tiny)
    over = lambda e: F.when(fits, F.try_divide(e, d))
    first = {
        "__a00": over(c("__yy") * c("__b00") - c("__xy") * c("__b10")), "__a01": over(c("__yy") * c("__b01") - c("__xy") * c("__b11")),
        "__a10": over(c("__xx") * c("__b10") - c("__xy") * c("__b00")), "__a11": over(c("__xx") * c("__b11") - c("__xy") * c("__b01")),
    }
    det = c("__a00") * c("__a11") - c("__a01") * c("__a10")
    second = {"__flip": F.when(det >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))}
    third = {"theta": F.atan2(c("__a10") - c("__flip") * c("__a01"), c("__a00") + c("__flip") * c("__a11"))}
    cos, sin, flip = F.cos("theta"), F.sin("theta"), c("__flip")
    # R = [[cos, -sin], [sin, cos]] or, with a reflection, [[cos, sin], [sin, -cos]]; the stretches are the diagonal of its transpose times the map
    fourth = {"scale_x": cos * c("__a00") + sin * c("__a10"), "scale_y": -flip * sin * c("__a01") + flip * cos * c("__a11")}
    fifth = {
        "shift_x": c("__tx") - (c("__mx") * cos + c("__my") * sin) * c("scale_x"),
        "shift_y": c("__ty") - (-flip * c("__mx") * sin + flip * c("__my") * cos) * c("scale_y"),
    }
    return [first, second, third, fourth, fifth]
