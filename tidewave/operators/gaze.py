"""Gaze recordings of any length: change of rate, fixations in blocks, and the metrics of a window in one table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import groups, slices, windows

#: Samples that are dealt as one row, and products that are summed at a time, at most.
PIECE, TERMS = 64, 1 << 20


def low_pass_taps(up: int, down: int, reach: int = 10, beta: float = 5.0) -> np.ndarray:
    """A sinc that passes what both rates can hold, ``reach`` turns to both sides under a Kaiser window; its sum is ``up``."""
    widest = max(up, down)
    half = reach * widest
    taps = np.sinc(np.arange(-half, half + 1) / widest) * np.kaiser(2 * half + 1, beta)
    return taps / taps.sum() * up


def resampled_parts(columns: list[np.ndarray], starts: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, taps: np.ndarray, up: int, down: int) -> tuple:
    """The number of samples, their places and values, of the new rate from place ``low`` to before ``high`` in each slice.

    Slices stand one after the other in ``columns``, at ``starts``; their first values are samples ``first`` of the old
    rate. What lies beyond a slice counts as zero.
    """
    half, lengths, ends = len(taps) // 2, high - low, np.append(starts[1:], len(columns[0]))
    whose = np.repeat(np.arange(len(starts)), lengths)
    places = np.arange(len(whose)) + (low - np.cumsum(lengths) + lengths)[whose]
    step, found = np.arange(2 * half // up + 1)[None, :], [np.empty(len(places)) for _ in columns]
    most = max(1, TERMS // step.size)
    for i in range(0, len(places), most):
        own, place = whose[i : i + most], places[i : i + most]
        near = -(-(place * down - half) // up)  # the first old sample that a new one hears
        tap = (place * down - near * up + half)[:, None] - step * up
        at = (near - first[own] + starts[own])[:, None] + step
        heard = (at >= starts[own][:, None]) & (at < ends[own][:, None]) & (tap >= 0)
        at, weight = np.where(heard, at, 0), np.where(heard, taps[np.maximum(tap, 0)], 0.0)
        for x, y in zip(columns, found, strict=True):
            y[i : i + most] = (np.where(heard, x[at], 0.0) * weight).sum(axis=1)
    return lengths, places, found


def resampled(df: DataFrame, recording: list[str], columns: list[str], up: int, down: int, size: int = slices.SLICE_ROWS) -> DataFrame:
    """recording, ``frame`` of the new rate, and ``columns`` at ``up`` / ``down`` times the old one, of framed rows.

    The signal is low-passed for the slower rate and taken at frame * down / up; beyond its ends it counts as zero, a
    sample that hears a missing value is NULL. A recording is cut into slices that know what their samples hear, so a
    task holds one slice, or a batch of small ones, and slices give what the whole recording gives.
    """
    taps = low_pass_taps(up, down)
    around = len(taps) // 2 // up + 1
    values = [f"x{i}" for i in range(len(columns))]

    def parts(rows: pa.RecordBatch, starts: np.ndarray) -> tuple:
        own, frame, frames = (rows.column(c).to_numpy(zero_copy_only=False)[starts] for c in ("__slice", "frame", "frames"))
        ends = np.cumsum(rows.column(values[0]).value_lengths().to_numpy(zero_copy_only=False))
        x = [rows.column(v).flatten().to_numpy(zero_copy_only=False) for v in values]
        begin = own * size
        end = np.minimum(begin + size, frames)
        lengths, places, found = resampled_parts(x, np.append(0, ends)[starts], frame, -(-begin * up // down), -(-end * up // down), taps, up, down)
        return lengths, [places, *found]

    # pieces of a recording are rows, of which each slice gets what it hears: far fewer rows to deal than one for each sample and slice
    piece = min(size, PIECE)
    sample = F.struct("frame", *[F.col(c).cast("double").alias(v) for c, v in zip(columns, values, strict=True)])
    whole = df.select(*recording, "frames", slices.slice_of("frame", piece).alias("__piece"), sample.alias("sample")).groupBy(*recording, "__piece").agg(F.max("frames").alias("frames"), F.sort_array(F.collect_list("sample")).alias("samples"))
    begin, n = F.col("__piece") * piece, F.size("samples")
    first = F.greatest(F.lit(0), slices.slice_of(begin - around, size))
    last = F.least(slices.slice_of(begin + n - 1 + around, size), slices.slice_of(F.col("frames") - 1, size))
    dealt = whole.withColumn("__slice", F.explode(F.sequence(first, last)))
    low = F.greatest(begin, F.col("__slice") * size - around)
    high = F.least(begin + n, (F.col("__slice") + 1) * size + around)
    heard = F.slice("samples", (low - begin + 1).cast("int"), (high - low).cast("int"))
    dealt = dealt.select(*recording, "__slice", low.alias("frame"), "frames", heard.alias("h")).select(*recording, "__slice", "frame", "frames", *[F.col("h")[v].alias(v) for v in values])
    found = groups.together(dealt, [*recording, "__slice"], ["frame"], parts, {"__place": "long", **dict.fromkeys(values, "double")})
    return found.select(*recording, F.col("__place").alias("frame"), *[F.when(~F.isnan(v), F.col(v)).alias(c) for c, v in zip(columns, values, strict=True)])


class _Block:
    """Samples of one block, in order: the anchor that follows any other, and where an anchor from outside ends."""

    def __init__(self, t: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float):
        self.t, self.x, self.y, self.radius = t, x, y, radius
        self.following: dict[int, int] = {}

    def leaves(self, x: float, y: float, start: int) -> int:
        """The first sample from ``start`` on that is further than the radius from a place; the number of samples if none is."""
        at = start
        while at < len(self.t):  # looked for in growing stretches, since most leave soon
            stop = min(len(self.t), at + 64 + (at - start))
            far = np.flatnonzero(np.sqrt((self.x[at:stop] - x) ** 2 + (self.y[at:stop] - y) ** 2) > self.radius)
            if len(far):
                return at + int(far[0])
            at = stop
        return at

    def after(self, i: int) -> int:
        if i not in self.following:
            self.following[i] = self.leaves(self.x[i], self.y[i], i + 1)
        return self.following[i]

    def last_anchor(self, i: int) -> int:
        while (n := self.after(i)) < len(self.t):
            i = n
        return i


def fixations(df: DataFrame, recording: list[str], t: str, x: str, y: str, radius: float, least: float, keep_last: bool = False, size: int = slices.SLICE_ROWS) -> DataFrame:
    """start, end, duration, x, y of fixations, as ``matching.fixations``, of framed rows, whose recordings may have any length.

    A block maps the anchor that it is entered with to the one that it is left with: once a sample is too far from the
    entry's place, all that follows depends on the block alone, so chains of anchors soon run together, and few anchors
    leave a block. First blocks tell which these are, and the box around their samples, by which most anchors are seen
    to pass or to end there. Then each block is asked about the others that may enter it. What really enters each block
    follows from these few rows a block; and blocks tell their fixations.
    """
    samples = df.select(*recording, "frame", *[F.col(c).cast("double").alias(n) for n, c in (("a", t), ("ax", x), ("ay", y))], slices.slice_of("frame", size).cast("long").alias("__cell"))
    rows = samples.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("a", "ax", "ay")))
    # blocks that hold a sample, numbered in order
    blocks = rows.groupBy(*recording, "__cell").agg(F.count("*").alias("__n"), F.max("a").alias("__until"))
    order = Window.partitionBy(*recording).orderBy("__cell")
    blocks = blocks.withColumns({"__block": F.row_number().over(order).cast("long") - 1, "final": F.lead("__cell").over(order).isNull().cast("long"), "before": F.lag("__until").over(order)})
    rows = slices.met(rows, blocks.select(*recording, "__cell", "__block", "final", "before"), [*recording, "__cell"]).drop("__cell").withColumn("block", F.col("__block")).persist()
    key = [*recording, "__block"]

    place, order = ["a", "ax", "ay"], ["a", "ax", "ay", "frame"]
    doubles = lambda *names: dict.fromkeys(names, "double")

    def columns(out: list[tuple], n: int) -> list:
        return [list(c) for c in zip(*out, strict=True)] if out else [[]] * n

    def exits(a: np.ndarray, ax: np.ndarray, ay: np.ndarray, block: np.ndarray) -> list:
        """The anchors that may leave a block if a sample of its own does, and the box around its samples; of the first block, the one that does."""
        b = _Block(a, ax, ay, radius)
        left = [b.last_anchor(0)]
        if block[0]:
            ends: dict[int, int] = {}
            for i in range(len(a) - 1, -1, -1):  # from the end on, so that each chain is one step
                n = b.after(i)
                ends[i] = ends[n] if n < len(a) else i
            left = sorted(set(ends.values()))
        return [a[left], ax[left], ay[left], *[[v] * len(left) for v in (ax.min(), ax.max(), ay.min(), ay.max())]]

    def possible(block: np.ndarray, a: np.ndarray, ax: np.ndarray, ay: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> list:
        """The anchors that each block of a recording may be entered with and that its box doesn't tell the fate of."""
        inside, out = set(), []
        starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for i, j in zip(starts, [*starts[1:], len(block)], strict=True):
            go_on = set()
            for c in inside:
                over, wide = max(c[1] - x0[i], x1[i] - c[1]), max(c[2] - y0[i], y1[i] - c[2])
                if (over**2 + wide**2) ** 0.5 <= radius * (1 - 1e-9):
                    go_on.add(c)  # all samples are near enough
                    continue
                out.append((int(block[i]), *c))
                if max(over, wide) <= radius:  # else the sample at that side of the box is too far
                    go_on.add(c)
            inside = go_on | set(zip(a[i:j].tolist(), ax[i:j].tolist(), ay[i:j].tolist(), strict=True))
        return columns(out, 4)

    def through(a: np.ndarray, ax: np.ndarray, ay: np.ndarray, sample: np.ndarray) -> list:
        """For each anchor that may enter: the one that leaves. Anchors stand before the samples."""
        asked, out = int((~sample).sum()), []
        b = _Block(a[asked:], ax[asked:], ay[asked:], radius) if asked else None
        for c in zip(a[:asked].tolist(), ax[:asked].tolist(), ay[:asked].tolist(), strict=True):
            i = b.leaves(c[1], c[2], 0)
            e = b.last_anchor(i) if i < len(b.t) else None
            out.append((*c, *(c if e is None else (b.t[e], b.x[e], b.y[e]))))
        return columns(out, 6)

    sampled = rows.select(*key, *order, "final", "before", F.lit(True).alias("sample"))
    entering = lambda found: found.select(*key, *place, *[F.lit(None).cast(k).alias(c) for c, k in (("frame", "long"), ("final", "long"), ("before", "double"))], F.lit(False).alias("sample"))
    summaries = groups.applied(rows.select(*key, *order, "block"), key, order, lambda frame, **c: exits(**c), doubles(*place, "x0", "x1", "y0", "y1")).persist()
    asked = groups.applied(summaries.withColumnRenamed("__block", "block"), recording, ["block"], possible, {"__block": "long", **doubles(*place)})
    maps = groups.applied(entering(asked).unionByName(sampled), key, ["sample", *order], lambda frame, final, before, **c: through(**c), doubles(*place, "b", "bx", "by"))

    def followed(block: np.ndarray, map: np.ndarray, a: np.ndarray, ax: np.ndarray, ay: np.ndarray, b: np.ndarray, bx: np.ndarray, by: np.ndarray) -> list:
        """What enters each block of a recording, from what leaves the first one. A block's own row stands before its map."""
        now, out = None, []
        steps: dict[tuple, tuple] = {}
        for of, mapped, c, d in zip(block.tolist(), map.tolist(), zip(a.tolist(), ax.tolist(), ay.tolist(), strict=True), zip(b.tolist(), bx.tolist(), by.tolist(), strict=True), strict=True):
            if mapped:
                steps[c] = d
                continue
            if of:
                now = steps.get(now, now)
                out.append((of, *now))
            else:
                now = c
            steps = {}
        return columns(out, 4)

    own = summaries.where("__block = 0").unionByName(summaries.where("__block > 0").groupBy(*key).agg(F.lit(0.0).alias("a")), allowMissingColumns=True)
    turns = own.select(*recording, F.col("__block").alias("block"), F.lit(False).alias("map"), *place, *[F.lit(None).cast("double").alias(c) for c in ("b", "bx", "by")])
    turns = turns.unionByName(maps.select(*recording, F.col("__block").alias("block"), F.lit(True).alias("map"), *place, "b", "bx", "by"))
    entered = groups.applied(turns, recording, ["block", "map"], followed, {"__block": "long", **doubles(*place)})

    def told(a: np.ndarray, ax: np.ndarray, ay: np.ndarray, final: np.ndarray, before: np.ndarray, sample: np.ndarray) -> list:
        first, out = int(not sample[0]), []
        b = _Block(a[first:], ax[first:], ay[first:], radius)
        now, last, i = (float(a[0]), float(ax[0]), float(ay[0])), float(before[1] if first else a[0]), 0
        while (n := b.leaves(now[1], now[2], i)) < len(b.t):
            last = b.t[n - 1] if n else last
            if last - now[0] >= least:
                out.append((now[0], last, last - now[0], now[1], now[2]))
            now, i = (b.t[n], b.x[n], b.y[n]), n + 1
        if final[-1] and (keep_last or b.t[-1] - now[0] >= least):
            out.append((now[0], b.t[-1], b.t[-1] - now[0], now[1], now[2]))
        return columns(out, 5)

    spells = groups.applied(entering(entered).unionByName(sampled), key, ["sample", *order], lambda frame, **c: told(**c), doubles("start", "end", "duration", "x", "y"))
    return spells.drop("__block")


def window_metrics(samples: DataFrame, fixed: DataFrame, blinks: DataFrame, recording: list[str], t: str, x: str, y: str, lost: str, size: float, hop: float, fast: float, most_missing: float = 0.25) -> DataFrame:
    """The recording, window_index, start_time, end_time and 13 metrics of each window of which at most ``most_missing`` is ``lost``; the index goes on.

    ``fixed`` and ``blinks`` (start, end) count where they start. Saccades are runs of samples whose speed exceeds
    ``fast``. Speeds are by the real time step; where that is zero, or a place is missing, there is none.
    """
    keys = [*recording, "window_index"]
    dealt = windows.by_time(samples, recording, t, size, hop)
    part = Window.partitionBy(*keys).orderBy(t)
    step = F.col(t) - F.lag(t).over(part)
    moved = dealt.withColumns({"__dt": step, "__v": F.try_divide(F.hypot(F.col(x) - F.lag(x).over(part), F.col(y) - F.lag(y).over(part)), step)})
    moved = moved.withColumn("__a", F.try_divide(F.col("__v") - F.lag("__v").over(part), F.col("__dt"))).withColumn("__fast", F.coalesce(F.col("__v") > fast, F.lit(False)))
    moved = moved.withColumn("__new", (F.col("__fast") & ~F.coalesce(F.lag("__fast").over(part), F.lit(False))).cast("int")).withColumn("__run", F.sum("__new").over(part))
    found = moved.groupBy(*keys).agg(
        F.min(t).alias("start_time"), F.max(t).alias("end_time"), (100 * F.avg(F.col(lost).cast("double"))).alias("pct_missing"), F.avg("__v").alias("mean_vel"), F.max("__v").alias("max_vel"), F.avg("__a").alias("mean_acc"),
        F.sqrt(F.var_pop(x) + F.var_pop(y)).alias("rms_disp"),
    )
    saccades = moved.where("__fast").groupBy(*keys, "__run").agg((F.max(t) - F.min(t)).alias("__d")).groupBy(*keys).agg(F.count("*").alias("sac_count"), F.avg("__d").alias("sac_mean_dur"))
    kept = found.where(F.col("pct_missing") <= 100 * most_missing)
    spans = F.sequence(F.greatest(F.lit(0), (F.floor((F.col("start") - size) / hop) + 1).cast("int")), F.floor(F.col("start") / hop).cast("int"))
    out = kept
    for name, events in (("fix", fixed), ("blink", blinks)):
        placed = events.select(*recording, "start", (F.col("end") - F.col("start")).alias("__d")).where("start >= 0").withColumn("window_index", F.explode(spans))
        inside = placed.join(kept.select(*keys, "start_time", "end_time"), keys).where("start between start_time and end_time")
        out = out.join(inside.groupBy(*keys).agg(F.count("*").alias(f"{name}_count"), F.avg("__d").alias(f"{name}_mean_dur")), keys, "left")
    out = out.join(saccades, keys, "left")
    counted = {f"{k}_count": F.coalesce(F.col(f"{k}_count"), F.lit(0)) for k in ("fix", "blink", "sac")}
    rates = {f"{k}_rate": F.try_divide(F.col(f"{k}_count").cast("double"), F.col("end_time") - F.col("start_time")) for k in ("fix", "blink", "sac")}
    return out.withColumns(counted).withColumns(rates)

