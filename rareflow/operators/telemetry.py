"""Per-run metrics from telemetry steps: one grouped aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANE, NEAR = 2.5, 0.7 * 2.5


def run_metrics(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Max and mean of |xte| and |steering|, steps, first step near the lane's edge: mergeable, so partial by task."""
    xte, steer = F.abs("xte"), F.abs("steering")
    return steps.groupBy(run).agg(
        F.count("*").alias("n_steps"), F.max(xte).alias("max_xte"), F.max(steer).alias("max_steer"), F.avg(steer).alias("avg_steer"),
        F.min(F.when(xte > NEAR, F.col("step"))).alias("first_near"),
    )


def composite_margin(metrics: DataFrame) -> DataFrame:
    """0.6 * lane margin, 0.2 * steering smoothness, 0.2 * time near the edge; null below three steps."""
    n = F.greatest(F.col("n_steps"), F.lit(1))
    m1 = LANE - F.col("max_xte")
    m2 = -F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("max_steer") - F.col("avg_steer")) / 0.4))
    m3 = -(n - F.coalesce("first_near", n)) / n
    return metrics.withColumn("margin", F.when(F.col("n_steps") >= 3, 0.6 * m1 + 0.2 * m2 + 0.2 * m3))


def complete_runs(design: DataFrame, metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """Every designed run; a lost job is an empty run: invalid, not a failure."""
    return design.join(metrics, run, "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0)))


def invalidity(runs: DataFrame, min_hz: float = 0.0, max_m_per_step: float = 0.0) -> DataFrame:
    """Flags degenerate, inconsistent and low-fidelity runs; their margin becomes null. A gate at 0 is off."""
    hz = F.coalesce(F.nanvl("control_hz", F.lit(None).cast("double")), F.lit(float("inf")))
    metres = F.coalesce(F.nanvl("meters_per_step", F.lit(None).cast("double")), F.lit(0.0))
    flags = runs.withColumns({
        "degenerate": F.col("n_steps") < 3,
        "inconsistent": F.coalesce(F.col("min_speed") > F.col("max_speed"), F.lit(False)),
        "low_fidelity": (F.lit(min_hz > 0) & (hz < min_hz)) | (F.lit(max_m_per_step > 0) & (metres > max_m_per_step)),
    })
    bad = F.col("degenerate") | F.col("inconsistent") | F.col("low_fidelity")
    return flags.withColumn("margin", F.when(~bad, F.col("margin")))


def loop_fidelity(elapsed: Column, iterations: Column, mean_kmh: Column) -> tuple[Column, Column]:
    """control_hz and meters_per_step; null where iterations or time are not positive."""
    ok = (elapsed > 0) & (iterations > 0)
    return F.when(ok, iterations / elapsed), F.when(ok, mean_kmh / 3.6 * elapsed / iterations)


def path_per_decision(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Mean path length between decisions from x and y; 0 below two steps."""
    w = Window.partitionBy(run).orderBy("step")
    far = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return steps.select(run, far.alias("far")).groupBy(run).agg(F.coalesce(F.avg("far"), F.lit(0.0)).alias("meters_per_decision"))


def failure_mode(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """oscillation, wrong-way or drift for each run, with the exit side."""
    agree = F.avg(F.when(F.abs("xte") > 0.2, F.signum("steering") * F.signum("xte")))
    out = steps.groupBy(run).agg(F.min("xte").alias("xmin"), F.max("xte").alias("xmax"), agree.alias("agree"), F.count("*").alias("n_steps"), F.max_by("xte", "step").alias("last_xte"))
    mode = F.when((F.col("xmin") < -1) & (F.col("xmax") > 1), "oscillation").when(F.col("agree") > 0.15, "wrong-way").when(F.col("n_steps") > 10, "late drift").otherwise("drift")
    return out.select(run, mode.alias("mode"), F.when(F.col("last_xte") < 0, "left").otherwise("right").alias("side"))


SILENT = "silent"


def end_reason(max_xte: float, max_seconds: float) -> Column:
    """Why a step (elapsed, xte, done, beyond_end) ends its run: the first of time, lane, done, road; null if it goes on."""
    return (
        F.when(F.col("elapsed") > max_seconds, "time").when(F.abs("xte") > max_xte, "lane").when(F.col("done"), "done").when(F.col("beyond_end"), "road")
    )


def episode_end(steps: DataFrame, max_xte: float, max_seconds: float, run: str = "run_id") -> DataFrame:
    """run, end_step, reason: the first step that ends the run, or its last one, with ``silent``, if none does."""
    reason = end_reason(max_xte, max_seconds)
    step = F.when(reason.isNotNull(), F.col("step"))
    got = steps.groupBy(run).agg(F.min(step).alias("end_step"), F.min_by(reason, step).alias("reason"), F.max("step").alias("last_step"))
    return got.select(run, F.coalesce("end_step", "last_step").cast("long").alias("end_step"), F.coalesce("reason", F.lit(SILENT)).alias("reason"))


def braking_margin(steps: DataFrame, params: DataFrame, run: str = "run_id") -> DataFrame:
    """Detection distance less the final position less 2 m."""
    last = steps.groupBy(run).agg(F.max_by("position", "step").alias("final"))
    return params.join(last, run).select(run, (F.col("detection_dist") - F.col("final") - 2.0).alias("margin"))


def cut_in_margin(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Smallest longitudinal gap while in lane, less 1.5; +inf if never in lane."""
    gap = F.min(F.when(F.col("lat_gap") < 1.75, F.col("long_gap")))
    return steps.groupBy(run).agg((F.coalesce(gap, F.lit(float("inf"))) - 1.5).alias("margin"))
