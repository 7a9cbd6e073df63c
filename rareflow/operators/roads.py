"""Roads as polylines: places relative to the centreline, headings, parity of two builds, curvature.

A road is one row (run_id, xy array<struct<x, y>>) of at most a few hundred vertices, so a step meets its road by one
equi-join and looks through the segments inside the row, a batch of rows at a time; steps are never multiplied by segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drivable(made: Column) -> Column:
    """``made`` for roads of two vertices or more; the others drop out.

    By explode, because a filter on a road that is computed from its key would be inferred for the steps that join it,
    and would build the road again for every step.
    """
    return F.explode(F.when(F.size("xy") >= 2, F.array(made)))


def segments(roads: DataFrame) -> DataFrame:
    """(run_id, seg): start, direction, length and arc length before each segment. Roads below two vertices drop out."""
    seg = F.expr("transform(sequence(0, size(xy) - 2), i -> named_struct('ax', xy[i].x, 'ay', xy[i].y, 'dx', xy[i + 1].x - xy[i].x, 'dy', xy[i + 1].y - xy[i].y))")
    length = F.expr("transform(seg, g -> sqrt(g.dx * g.dx + g.dy * g.dy))")
    ready = roads.select("run_id", drivable(seg).alias("seg")).withColumn("length", length)
    before = "aggregate(slice(length, 1, i), 0D, (a, x) -> a + x)"
    return ready.select("run_id", F.expr(f"transform(seg, (g, i) -> named_struct('ax', g.ax, 'ay', g.ay, 'dx', g.dx, 'dy', g.dy, 'len', length[i], 's0', {before}))").alias("seg"))


#: Rows whose segments are looked through at a time.
ROWS = 2048


def nearest_segment(px: pa.Array, py: pa.Array, ax: pa.Array, ay: pa.Array, dx: pa.Array, dy: pa.Array) -> pa.Array:
    """For each position and the segments of its road: struct (d, i, t) of the nearest one, the first on ties. As in SQL
    an unknown distance (null) comes first and what is not a number last."""
    columns = (px, py, ax, ay, dx, dy)
    return pa.concat_arrays([_nearest_segment(*[c.slice(k, ROWS) for c in columns]) for k in range(0, max(1, len(px)), ROWS)])


def _nearest_segment(px: pa.Array, py: pa.Array, ax: pa.Array, ay: pa.Array, dx: pa.Array, dy: pa.Array) -> pa.Array:
    counts = np.diff(ax.offsets.to_numpy())
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    ends = [c.flatten() for c in (ax, ay, dx, dy)]
    unknown = (~(px.is_valid().to_numpy(zero_copy_only=False) & py.is_valid().to_numpy(zero_copy_only=False)))[row]
    for c in ends:
        if c.null_count:
            unknown |= ~c.is_valid().to_numpy(zero_copy_only=False)
    x, y = (c.to_numpy(zero_copy_only=False).astype(float)[row] for c in (px, py))
    ax, ay, dx, dy = (c.to_numpy(zero_copy_only=False).astype(float) for c in ends)
    with np.errstate(all="ignore"):
        t = np.fmin(1.0, np.maximum(0.0, ((x - ax) * dx + (y - ay) * dy) / np.fmax(dx * dx + dy * dy, 1e-18)))
        t[unknown] = 0.0
        off_x, off_y = ax + t * dx - x, ay + t * dy - y
        d = np.sqrt(off_x * off_x + off_y * off_y)
    order = np.where(unknown, -1.0, np.where(np.isnan(d), np.inf, np.minimum(d, np.finfo(float).max)))
    least = np.minimum.reduceat(order, starts) if len(starts) else order
    hits = np.flatnonzero(order == np.repeat(least, counts))
    first = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]
    return pa.StructArray.from_arrays(
        [pa.array(d[first], mask=unknown[first]), pa.array((first - starts).astype("int32")), pa.array(t[first])], names=["d", "i", "t"])


def nearest(positions: DataFrame, roads: DataFrame) -> DataFrame:
    """Adds near (d, i, t): distance, index and place of the nearest segment; the first one on ties."""
    look = F.arrow_udf(nearest_segment, "d double, i int, t double")
    place = [F.col(c).cast("double") for c in ("px", "py")]
    return positions.join(segments(roads), "run_id").withColumn("near", look(*place, *[F.col("seg")[c] for c in ("ax", "ay", "dx", "dy")]))


def wrap_pi(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def road_frame(positions: DataFrame, roads: DataFrame) -> DataFrame:
    """Adds lateral (left positive), heading_error, s, beyond_end and before_start to (run_id, px, py, yaw)."""
    rows = nearest(positions, roads).withColumn("g", F.expr("seg[near.i]"))
    d, t, g = F.col("near.d"), F.col("near.t"), F.col("g")
    cross = g["dx"] * (F.col("py") - (g["ay"] + t * g["dy"])) - g["dy"] * (F.col("px") - (g["ax"] + t * g["dx"]))
    return rows.withColumns({
        "lateral": F.when(cross < 0, -d).otherwise(d), "heading_error": wrap_pi(F.col("yaw") - F.atan2(g["dy"], g["dx"])), "s": g["s0"] + t * g["len"],
        "beyond_end": (F.col("near.i") == F.size("seg") - 1) & (t >= 1 - 1e-9), "before_start": (F.col("near.i") == 0) & (t <= 1e-9),
    }).drop("seg", "g", "near")


def headings(steps: DataFrame, roads: DataFrame, order: list[str], still: float = 1e-6) -> DataFrame:
    """Adds yaw from consecutive positions; a step that hardly moves keeps the last one, the first has the road's tangent."""
    w = Window.partitionBy("run_id").orderBy(*order)
    dx, dy = F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)
    moved = steps.withColumns({"dx": dx, "dy": dy}).withColumn("own", F.when(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) >= still, F.atan2("dy", "dx")))
    kept = moved.withColumn("yaw", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("dx", "dy", "own")
    first = roads.select("run_id", drivable(F.expr("atan2(xy[1].y - xy[0].y, xy[1].x - xy[0].x)")).alias("tangent"))
    return kept.join(first, "run_id").withColumn("yaw", F.coalesce("yaw", "tangent")).drop("tangent")


def lateral_agreement(frames: DataFrame, least: float = 0.05) -> DataFrame:
    """Largest difference of |xte| and |lateral|, and the share of equal signs where both exceed ``least``, for each run."""
    both = (F.abs("xte") > least) & (F.abs("lateral") > least)
    same = F.when(both, (F.signum("xte") == F.signum("lateral")).cast("double"))
    return frames.groupBy("run_id").agg(F.max(F.abs(F.abs("xte") - F.abs("lateral"))).alias("max_diff"), F.avg(same).alias("same_sign"))


def parity(reference: DataFrame, built: DataFrame, edge: float = 2.0, least: int = 10, limit: float = 0.10) -> DataFrame:
    """One row for each reference road: deviation of the built road's vertices from it, and whether it is within the limit.

    Vertices nearer to an end than ``edge`` do not count, unless fewer than ``least`` remain. A road that was not built
    has no deviations and is not ok.
    """
    total = segments(built).select("run_id", F.expr("aggregate(seg, 0D, (a, g) -> a + g.len)").alias("len_built"), F.expr("concat(transform(seg, g -> g.s0), array(element_at(seg, -1).s0 + element_at(seg, -1).len))").alias("along"))
    vertices = built.join(total, "run_id").select("run_id", "len_built", F.explode(F.arrays_zip("xy", "along")).alias("v")).select("run_id", "len_built", F.col("v.xy.x").alias("px"), F.col("v.xy.y").alias("py"), F.col("v.along").alias("s"))
    inside = (F.col("s") > edge) & (F.col("s") < F.col("len_built") - edge)
    dev, part = F.col("near.d"), F.count_if("inside") >= least
    per = nearest(vertices, reference).withColumn("inside", inside).groupBy("run_id").agg(
        F.when(part, F.avg(F.when(F.col("inside"), dev))).otherwise(F.avg(dev)).alias("mean_dev"), F.when(part, F.max(F.when(F.col("inside"), dev))).otherwise(F.max(dev)).alias("max_dev"), F.max("len_built").alias("len_built"))
    length = segments(reference).select("run_id", F.expr("aggregate(seg, 0D, (a, g) -> a + g.len)").alias("len_ref"))
    return length.join(per, "run_id", "left").select("run_id", "mean_dev", "max_dev", (F.col("len_built") / F.col("len_ref")).alias("length_ratio"), F.coalesce(F.col("max_dev") <= limit, F.lit(False)).alias("ok"))


def curvature(roads: DataFrame) -> DataFrame:
    """1 / the smallest radius of the circle through vertices i, i + 2, i + 4; the last start does not count; 0 if straight."""
    a, b, c = "xy[i]", "xy[i + 2]", "xy[i + 4]"
    det = f"(({a}.x - {b}.x) * ({b}.y - {c}.y) - ({b}.x - {c}.x) * ({a}.y - {b}.y))"
    side = lambda p, q: f"(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y))"
    inverse = f"CASE WHEN abs({det}) < 1e-6 THEN 0D ELSE 2 * abs({det}) / sqrt({side(a, b)} * {side(b, c)} * {side(a, c)}) END"
    return roads.select("run_id", F.expr(f"CASE WHEN size(xy) > 5 THEN array_max(transform(sequence(0, size(xy) - 6), i -> {inverse})) ELSE 0D END").alias("curvature"))
