"""Backend comparison, envelopes, sweeps, repeatability and drivability."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import exact_quantiles
from .design import to_unit
from .rates import failure_rate
from .density import dbscan
from .regions import discoveries, overlaps


def backend_summary(runs: DataFrame) -> DataFrame:
    """Valid runs, failure rate (null without valid runs) and median control rate of each backend."""
    fail = F.count_if(F.col("valid") & (F.col("margin") < 0))
    n = F.count_if("valid")
    got = runs.groupBy("backend").agg(n.alias("n_valid"), (fail / F.when(n > 0, n)).alias("failure_rate"), *([F.max("speed_scale").alias("speed_scale")] if "speed_scale" in runs.columns else []))
    return got.join(exact_quantiles(runs, F.col("control_hz"), {"median_hz": 0.5}, ["backend"]), "backend", "left")


def shared_design(a: DataFrame, b: DataFrame, tolerance: float = 0.51) -> DataFrame:
    """Whether two backends ran the same scenarios: same indices, and no parameter further apart than the tolerance."""
    both = a.select("scenario_idx", F.col("theta").alias("x")).join(b.select("scenario_idx", F.col("theta").alias("y")), "scenario_idx", "full_outer")
    far = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_alone"), F.max(far).alias("max_delta"), F.coalesce(F.bool_and(far <= tolerance), F.lit(False)).alias("same"))


def backend_regions(runs: DataFrame, lower: list[float], upper: list[float], eps: float) -> DataFrame:
    """How two or more backends share failure regions: Jaccard, shared and one-sided counts of each pair.

    A failure is a margin below 0, whether the run counts as valid or not. Runs at the same place are one point of the
    clustering, so that repeated settings add no pairs. No rows where no backend has a failure.
    """
    fails = runs.where("margin < 0").select(F.col("backend").alias("owner"), to_unit(F.col("theta"), lower, upper).alias("u"))
    places = fails.select("u").distinct().withColumn("point_id", F.xxhash64("u"))
    labels = dbscan(places, eps)
    return overlaps(discoveries(fails.join(places, "u").join(labels, "point_id")))


def envelope(points: DataFrame, value: str, bins: int) -> DataFrame:
    """Failure rate with Wilson bounds in equal-width bins over the observed range; the last bin is closed."""
    ends = points.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)), F.lit(bins - 1)).cast("int")
    return failure_rate(points.join(F.broadcast(ends)).withColumn("bin", b), ["bin"])


def crossing(rates: DataFrame, level: float = 0.5) -> DataFrame:
    """Where p first crosses a level between consecutive bins (columns x, p): linear interpolation."""
    w = Window.orderBy("x")
    prev = rates.withColumns({"x0": F.lag("x").over(w), "p0": F.lag("p").over(w)})
    crossed = prev.where((F.col("p0") - level) * (F.col("p") - level) <= 0).where("p <> p0")
    return crossed.orderBy("x").limit(1).select((F.col("x0") + (level - F.col("p0")) / (F.col("p") - F.col("p0")) * (F.col("x") - F.col("x0"))).alias("threshold"))


def sweep_summary(cells: DataFrame) -> DataFrame:
    """Failure percentage, valid runs and median margin of each (angle_max, speed_max) cell."""
    n = F.count("margin")
    by = ["angle_max", "speed_max"]
    got = cells.groupBy(*by).agg((100.0 * F.count_if(F.col("margin") < 0) / F.when(n > 0, n)).alias("fail_pct"), n.alias("n_valid"))
    return got.join(exact_quantiles(cells, F.col("margin"), {"median_margin": 0.5}, by), by, "left")


def in_band(summary: DataFrame, low: float = 20.0, high: float = 40.0, aim: float = 30.0, k: int = 5) -> DataFrame:
    """The cells whose failure percentage is in the band, nearest to the aim first; if there are none, the k nearest cells.

    A sweep has few cells, so one task orders them."""
    ordered = summary.where("fail_pct is not null").withColumns({"away": F.abs(F.col("fail_pct") - aim), "inside": F.col("fail_pct").between(low, high)})
    rank = F.row_number().over(Window.orderBy("away", "angle_max", "speed_max"))
    some = F.max("inside").over(Window.partitionBy(F.lit(0)))
    return ordered.withColumns({"rank": rank, "some": some}).where(F.when(F.col("some"), F.col("inside")).otherwise(F.col("rank") <= k)).drop("some")


def sweep_matrix(summary: DataFrame, speeds: list) -> DataFrame:
    return summary.groupBy("angle_max").pivot("speed_max", speeds).agg(F.first("fail_pct"))


def repeatability(runs: DataFrame, repeats: int) -> DataFrame:
    """One row over the points that are valid in every repeat: always fail, always pass, flipped, rates, spreads."""
    per = runs.groupBy("point_id").agg(F.count("margin").alias("n"), F.bool_and(F.col("margin") < 0).alias("all_fail"), F.bool_or(F.col("margin") < 0).alias("any_fail"), F.stddev_samp("margin").alias("sd"), (F.max("margin") - F.min("margin")).alias("range"), F.avg("margin").alias("mean"))
    per = per.where(F.col("n") == repeats)
    flipped = F.col("any_fail") & ~F.col("all_fail")
    got = per.agg(
        F.count("*").alias("n_points"), F.count_if("all_fail").alias("n_fail"), F.count_if(~F.col("any_fail")).alias("n_pass"), F.count_if(flipped).alias("n_flipped"),
        F.max("range").alias("max_range"), F.count_if(flipped & (F.abs("mean") < 0.2)).alias("n_near_flips"),
    )
    one = F.lit(1).alias("__one")
    return got.withColumn("__one", one).join(exact_quantiles(per, F.col("sd"), {"median_sd": 0.5}, []).withColumn("__one", one), "__one", "left").drop("__one")


def verdict(flip_rate: Column) -> Column:
    return F.when(flip_rate <= 0.05, "repeatable").when(flip_rate <= 0.20, "noisy").otherwise("not repeatable")


def turn_radius(angle_deg: Column, arc: Column) -> Column:
    """Arc length over angle, within 15 m and 10 km; below one degree the road is straight."""
    return F.when(F.abs(angle_deg) < 1, 1e4).otherwise(F.least(F.lit(1e4), F.greatest(F.lit(15.0), arc / F.radians(F.abs(angle_deg)))))


def drivability(roads: DataFrame, scales: list[float], mu: float = 0.8, g: float = 9.81) -> DataFrame:
    """Share of roads whose lateral acceleration passes mu g at each speed scale. Roads hold radius and speed (m/s)."""
    scaled = roads.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    a = F.pow(F.col("speed") * F.col("scale"), F.lit(2)) / F.col("radius")
    fastest = F.sqrt(0.6 * mu * g * F.col("radius"))
    got = scaled.groupBy("scale").agg(F.avg((a > mu * g).cast("double")).alias("over"), F.min(fastest).alias("v_max"), F.min(fastest / (F.col("speed") * F.col("scale"))).alias("min_ratio"))
    return got.join(exact_quantiles(scaled, a, {"median_a": 0.5}, ["scale"]), "scale", "left")


def episode_steps(length: Column, speed: Column, hz: float) -> Column:
    """Steps of an episode: 1.5 times the travel time, between 10 and 120 s."""
    budget = F.least(F.lit(120.0), F.greatest(F.lit(10.0), length / speed * 1.5))
    return F.ceil(budget * hz)


def arc_length(vertices: DataFrame, road: str = "run_id") -> DataFrame:
    """Length and bounding box of each road."""
    w = Window.partitionBy(road).orderBy("vertex")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return vertices.withColumn("ds", step).groupBy(road).agg(F.sum("ds").alias("length"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def best_so_far(points: DataFrame, run: str, order: str) -> DataFrame:
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("best", F.min("margin").over(w))


def worst_cases(points: DataFrame, k: int) -> DataFrame:
    """The k worst points of each arm, ranked; invalid points do not take part.

    Each (arm, bucket of points) gives its own k first, so no task sorts an arm."""
    salt = F.pmod(F.xxhash64("point_id"), F.lit(64))
    order = ["margin", "point_id"]
    first = points.where("margin is not null").withColumn("__salt", salt)
    few = first.withColumn("rank", F.row_number().over(Window.partitionBy("arm", "__salt").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("arm").orderBy(*order))).where(F.col("rank") <= k).drop("__salt")


def calibrate(rate_at, low: float, high: float, band: tuple[float, float] = (0.10, 0.20), rounds: int = 10) -> dict:
    """Bisection of a monotone failure rate to a band. ``rate_at`` runs one Spark rate job and returns a number."""
    history: list[tuple[float, float]] = []

    def at(x: float) -> float:
        history.append((x, rate_at(x)))
        return history[-1][1]

    lo, hi = at(low), at(high)
    inside = lambda p: band[0] <= p <= band[1]
    outcome = "centred" if inside(lo) or inside(hi) else "too easy" if max(lo, hi) < band[0] else "broken" if min(lo, hi) > band[1] else ""
    while not outcome and len(history) < rounds:
        mid = (low + high) / 2
        p = at(mid)
        if inside(p):
            outcome = "centred"
        elif (p > band[1]) == (hi > lo):
            high = mid
        else:
            low = mid
    away = lambda p: max(band[0] - p, p - band[1], 0.0)
    best = min(history, key=lambda h: (away(h[1]), history.index(h)))
    return {"outcome": outcome or "exhausted", "lever": best[0], "rate": best[1], "history": history}


def fidelity_report(runs: DataFrame, by: str) -> DataFrame:
    """Range and median of the control rate, median inference and waiting time, the waiting share and what bounds the loop."""
    got = runs.groupBy(by).agg(F.min("control_hz").alias("hz_min"), F.max("control_hz").alias("hz_max"), F.count_if(~F.col("valid")).alias("n_invalid"))
    for source, name in (("control_hz", "hz_median"), ("infer_ms", "infer_ms"), ("wait_ms", "wait_ms")):
        got = got.join(exact_quantiles(runs, F.col(source), {name: 0.5}, [by]), by, "left")
    total = F.col("infer_ms") + F.col("wait_ms")
    return got.withColumns({"wait_share": F.when(total > 0, F.col("wait_ms") / total * 100), "bottleneck": F.when(F.col("wait_ms") >= F.col("infer_ms"), "simulator").otherwise("inference")})


def comparison_caveats(summary: DataFrame, shared: DataFrame) -> DataFrame:
    """(subject, caveat) of a comparison: degenerate rates, unequal speed_scale or control rates, different designs.

    ``summary`` has one row a backend (backend, n_valid, failure_rate, median_hz, speed_scale); ``shared`` one row
    (pair, same) for each pair of backends.
    """
    rate = F.when(F.col("failure_rate").isNull(), "no valid run").when(F.col("failure_rate") <= 0, "0% failures").when(F.col("failure_rate") >= 1, "100% failures")
    degenerate = summary.select(F.col("backend").alias("subject"), rate.alias("caveat"))
    hz = F.max("median_hz") / F.greatest(F.min("median_hz"), F.lit(1e-9))
    whole = summary.agg(F.when(F.count_distinct(F.round("speed_scale", 4)) > 1, "different speed_scale").alias("a"), F.when((F.count("*") >= 2) & (hz > 1.5), "different control rates").alias("b"))
    unequal = whole.select(F.lit("all").alias("subject"), F.explode(F.array("a", "b")).alias("caveat"))
    designs = shared.select(F.col("pair").alias("subject"), F.when(~F.col("same"), "different designs").alias("caveat"))
    return degenerate.unionByName(unequal).unionByName(designs).where("caveat is not null")
