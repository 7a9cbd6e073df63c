"""Ranking of search arms and the tests on their seed-paired scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odd import normal_cdf
from ..functions.ranges import average_ranks, exact_quantiles, prefix_sums, stored


def arm_scores(scored: DataFrame, by: list[str] = ["arm"]) -> DataFrame:
    """Failures and rare failures per 100 valid points, worst and 5th percentile margin. Needs margin and is_rare."""
    fail = F.col("margin") < 0
    counts = scored.groupBy(*by).agg(F.count("margin").alias("n_valid"), F.count_if(fail).alias("n_failures"), F.count_if(fail & F.col("is_rare")).alias("n_rare"), F.min("margin").alias("worst_margin"))
    got = counts.join(exact_quantiles(scored, F.col("margin"), {"margin_q05": 0.05}, by), by, "left")
    n = F.col("n_valid")
    return got.withColumns({f"{k}_per_100": F.when(n > 0, 100.0 * F.col(f"n_{k}") / n).otherwise(0.0) for k in ("failures", "rare")})


def failure_percentiles(scored: DataFrame, percentiles: DataFrame, by: list[str] = ["arm"]) -> DataFrame:
    """Median operational percentile of each arm's failures; ``percentiles``: (lf, odd_percentile)."""
    fails = scored.where("margin < 0").join(percentiles, "lf")
    return exact_quantiles(fails, F.col("odd_percentile"), {"median_percentile": 0.5}, by)


def quality_notes(scores: DataFrame, n_seeds: int | None, usable: DataFrame | None = None) -> DataFrame:
    """(note, detail): no failure at all, no paired test and why, arms whose failure probability is not usable.

    ``scores`` has one row an arm (arm, n_valid, n_failures); ``n_seeds`` is None where points carry no seeds;
    ``usable``: (arm, all_usable).
    """
    total = scores.agg(F.sum("n_failures").alias("f"), F.sum("n_valid").alias("n"))
    notes = total.where("coalesce(f, 0) = 0").select(F.lit("no failures").alias("note"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" valid points")).alias("detail"))
    if n_seeds is None or n_seeds < 2:
        why = "points carry no seeds" if n_seeds is None else f"{n_seeds} seeds, 2 are needed"
        notes = notes.unionByName(total.select(F.lit("no paired test").alias("note"), F.lit(why).alias("detail")))
    if usable is not None:
        notes = notes.unionByName(usable.where("not all_usable").select(F.lit("p_fail not usable").alias("note"), F.col("arm").alias("detail")))
    return notes


def leaderboard(scores: DataFrame, metric: str) -> DataFrame:
    """Ranks on a metric, best first, ties by arm name. One row for each arm, so one task is enough."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "arm")))


def per_seed(scored: DataFrame) -> DataFrame:
    """100 * rare failures / max(valid points, 1) for each arm and seed; a seed with invalid points only scores 0."""
    rare = F.count_if((F.col("margin") < 0) & F.col("is_rare"))
    return scored.where("seed is not null").groupBy("arm", "seed").agg((100.0 * rare / F.greatest(F.count("margin"), F.lit(1))).alias("score"))


def common_seed_pairs(seeds: DataFrame) -> DataFrame:
    """(arm_a, arm_b, seed, a, b) for all pairs of arms over the seeds that every arm has."""
    arms = seeds.select("arm").distinct().agg(F.count("*").alias("n_arms"))
    common = seeds.groupBy("seed").agg(F.count_distinct("arm").alias("n")).join(F.broadcast(arms), F.col("n") == F.col("n_arms")).select("seed")
    held = seeds.join(common, "seed")
    a = held.select("seed", F.col("arm").alias("arm_a"), F.col("score").alias("a"))
    b = held.select("seed", F.col("arm").alias("arm_b"), F.col("score").alias("b"))
    return a.join(b, "seed").where("arm_a < arm_b").select("arm_a", "arm_b", "seed", "a", "b")


#: Untied differences up to which the signed-rank test counts instead of approximating.
EXACT = 50


def signed_rank_tail(m: Column, tail: Column) -> Column:
    """Two-sided p of m untied differences: how many subsets of the ranks 1 .. m have a sum of at most ``tail``.

    The counts of all sums grow by one rank at a time: each is that without the rank, and that with it.
    """
    def with_rank(ways: Column, r: Column) -> Column:
        none = F.array_repeat(F.lit(0.0), r)
        return F.zip_with(F.concat(ways, none), F.concat(none, ways), lambda x, y: x + y)

    ways = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.array(F.lit(1.0)), with_rank)
    low = F.aggregate(F.slice(ways, F.lit(1), F.floor(tail).cast("int") + 1), F.lit(0.0), lambda x, y: x + y)
    return F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), m))


def paired_tests(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n, wins, w_plus and two-sided signed-rank p for each group of pairs (a, b).

    Non-finite pairs drop; fewer than two, or none that differ, give no p. Zeros drop; p is exact for at most EXACT untied
    differences, else normal with tie correction and without continuity correction. Equal sizes are grouped before they
    are ranked; a group has one row for each seed.
    """
    d = F.col("a") - F.col("b")
    held = pairs.withColumn("__d", F.when(F.abs(d) < float("inf"), d))  # null and not-a-number are not below infinity
    count = held.groupBy(*keys).agg(F.count("__d").alias("n"), F.count_if(F.col("__d") > 0).alias("wins"))
    sizes = held.where(F.col("__d") != 0).groupBy(*keys, F.abs("__d").alias("__size")).agg(F.count("*").alias("t"), F.count_if(F.col("__d") > 0).alias("up"))
    rank = F.sum("t").over(Window.partitionBy(*keys).orderBy("__size")) - F.col("t") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    ranked = sizes.withColumn("r", rank).groupBy(*keys).agg(F.sum("t").alias("m"), F.sum(F.col("r") * F.col("up")).alias("w"), F.sum(t * t * t - t).alias("ties"), F.max("t").alias("most"))
    m, w = F.col("m"), F.col("w")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    z = F.when(sd > 0, F.abs(w - m * (m + 1) / 4) / sd).otherwise(0.0)
    exact = (m <= EXACT) & (F.col("most") == 1)
    tested = ranked.withColumn("p", F.when(exact, signed_rank_tail(m, F.least(w, m * (m + 1) / 2 - w))).otherwise(2 * normal_cdf(-z)))
    enough = F.col("n") >= 2
    return count.join(tested, keys, "left").select(*keys, "n", "wins", F.when(enough, w).alias("w_plus"), F.when(enough, F.col("p")).alias("p"))


def holm(tests: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p over the finite p of each family; missing p stay missing."""
    part = Window.partitionBy(*by, F.col("p").isNull())
    m, i = F.count("p").over(part), F.row_number().over(part.orderBy("p", *[c for c in ("arm_a", "arm_b") if c in tests.columns])) - 1
    raw = tests.withColumn("__raw", F.least(F.lit(1.0), (m - i) * F.col("p"))).withColumn("__i", i)
    run = F.max("__raw").over(part.orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn("p_holm", F.when(F.col("p").isNotNull(), run)).withColumn("significant", F.coalesce(F.col("p_holm") < alpha, F.lit(False))).drop("__raw", "__i")


def smallest_p(n: Column) -> Column:
    return F.pow(F.lit(2.0), 1 - n)


def fixed_sequence(plan: DataFrame, seeds: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Hypotheses (pos, id, a, b, direction) in order at full alpha; the first that is not rejected stops the rest.

    One-sided p: half of p if wins are a majority in the declared direction, else 1. A missing arm or fewer than two
    common seeds stop; two arms that score 0 throughout are void. Pairs use the two arms' own common seeds.
    """
    first = plan.join(seeds.select(F.col("arm").alias("a"), "seed", F.col("score").alias("x")), "a")
    both = first.join(seeds.select(F.col("arm").alias("b"), "seed", F.col("score").alias("y")), ["b", "seed"])
    flip = F.col("direction") == "b>a"
    ordered = both.select("pos", F.when(flip, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(flip, F.col("x")).otherwise(F.col("y")).alias("b"))
    tests = paired_tests(ordered, ["pos"]).join(ordered.groupBy("pos").agg(F.max(F.greatest(F.abs("a"), F.abs("b"))).alias("most")), "pos")
    got = plan.join(tests, "pos", "left")
    p = F.when(F.col("direction") == "two-sided", F.col("p")).when(F.col("p").isNull(), None).when(F.col("wins") * 2 > F.col("n"), F.col("p") / 2).otherwise(1.0)
    got = got.withColumn("p_used", p).withColumn("__reject", F.coalesce(p < alpha, F.lit(False)))
    before = F.coalesce(F.min("__reject").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    status = F.when(~before, "not tested").when(F.col("most") == 0, "void").when(F.col("__reject"), "rejected").otherwise("not rejected")
    return got.withColumn("status", status).select("pos", "id", "a", "b", "direction", "n", "wins", "p_used", "status")


def run_rows(points: DataFrame) -> DataFrame:
    """One row for each (arm, seed): evaluations, failures, worst and 5th percentile margin."""
    got = points.groupBy("arm", "seed").agg(F.count("margin").alias("n_evaluations"), F.count_if(F.col("margin") < 0).alias("n_failures"), F.min("margin").alias("worst_margin"))
    return got.join(exact_quantiles(points, F.col("margin"), {"margin_q05": 0.05}, ["arm", "seed"]), ["arm", "seed"], "left")


def arm_statistics(runs: DataFrame) -> DataFrame:
    """Mean and spread over seeds; the spread of one seed is 0. A run without ``p_fail_usable`` counts as usable."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    usable = F.col("p_fail_usable") if "p_fail_usable" in runs.columns else F.lit(True)
    return runs.groupBy("arm").agg(
        F.count("*").alias("n_seeds"), F.avg("p_fail").alias("p_mean"), sd("p_fail").alias("p_std"), F.avg("n_failures").alias("failures_mean"), sd("n_failures").alias("failures_std"),
        F.avg("n_evaluations").alias("evaluations_mean"), F.min("worst_margin").alias("min_margin"), (sd("p_fail") / F.when(F.avg("p_fail") != 0, F.avg("p_fail"))).alias("cv"), F.bool_and(usable).alias("all_usable"),
    )


def average_rank(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(rows: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """Rank correlation with average ranks for each group; null below ``least`` rows or for a constant side."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ok.withColumns({"__x": average_rank(x, by), "__y": average_rank(y, by)})
    got = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("__x", "__y").alias("both"), F.stddev_pop("__x").alias("sx"), F.stddev_pop("__y").alias("sy"))
    fine = (F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return got.select(*by, "n", F.when(fine, F.col("both") / (F.col("sx") * F.col("sy"))).alias("rho"))


def rank_correlation(rows: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """One row (n, rho, p) over all rows, for any number of them; null rho below ``least`` rows or for a constant side.

    p is two-sided from Student's t with n - 2 degrees, by its incomplete beta function on the driver.
    """
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(ok, x, "__x"), y, "__y")
    got = ranked.agg(F.count("*").alias("n"), F.covar_pop("__x", "__y").alias("both"), F.stddev_pop("__x").alias("sx"), F.stddev_pop("__y").alias("sy")).first()
    fine = got["n"] >= least and (got["sx"] or 0) > 0 and (got["sy"] or 0) > 0
    rho = max(-1.0, min(1.0, got["both"] / (got["sx"] * got["sy"]))) if fine else None
    p = student_p(rho, got["n"]) if fine else None
    return rows.sparkSession.createDataFrame([(got["n"], rho, p)], "n long, rho double, p double")


def drift(runs: DataFrame, alpha: float = 0.05, least: int = 5) -> DataFrame:
    """n_runs, rho, p of the rank correlation of run_index and n_failures over all arms' runs, and whether the arms were mixed.

    ``interleaved``: the runs in order change their arm more often than one block an arm would. Without it, drift and arm
    cannot be told apart. ``computable`` is false where one side does not vary; below ``least`` runs there is no row.
    A campaign's runs are few, so one task puts them in order.
    """
    held = runs.where(F.col("run_index").isNotNull()).select("arm", "run_index", "n_failures")
    before = F.lag("arm").over(Window.orderBy("run_index", "arm"))
    mixed = held.withColumn("before", before).agg((1 + F.count_if(F.col("arm") != F.col("before")) > F.count_distinct("arm")).alias("interleaved"))
    got = rank_correlation(held, "run_index", "n_failures", least).where(F.col("n") >= least)
    computable = F.col("rho").isNotNull() & F.col("p").isNotNull()
    return got.crossJoin(mixed).select(F.col("n").alias("n_runs"), "rho", "p", "interleaved", computable.alias("computable"), F.coalesce(F.col("p") < alpha, F.lit(False)).alias("drift_detected"))


def student_p(rho: float, n: int) -> float:
    """Two-sided p of a correlation: I(v / (v + t^2); v / 2, 1 / 2), a continued fraction (modified Lentz)."""
    v = n - 2
    if v < 1:
        return math.nan
    if rho == 0 or abs(rho) >= 1:
        return 1.0 if rho == 0 else 0.0
    x, a, b = 1 - rho * rho, v / 2, 0.5
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    tail = front * (f - 1) if f != 1 else 0.0
    return min(1.0, max(0.0, 1 - tail if swap else tail))


def lhs_vs_random(runs: DataFrame, metrics: dict[str, int]) -> DataFrame:
    """family, metric, n, means and deviations of both designs, LHS wins in the metric's direction and p, over the seeds
    both designs have.

    Arms are named family[design+suffix]; families without both designs drop out; of several arms of one family and
    design the last name counts; a metric that the runs lack is left out; p_fail counts only where it is usable on all
    seeds of both arms.
    """
    form = r"^([^\[]+)\[(lhs|random)"
    metrics = {m: s for m, s in metrics.items() if m in runs.columns}
    named = runs.withColumns({"family": F.regexp_extract("arm", form, 1), "design": F.regexp_extract("arm", form, 2)}).where("design <> ''")
    last = named.groupBy("family", "design").agg(F.max("arm").alias("arm"))
    parts = named.join(last, ["family", "design", "arm"], "left_semi")
    if "p_fail_usable" in runs.columns and "p_fail" in metrics:
        fine = parts.groupBy("family").agg(F.bool_and("p_fail_usable").alias("__fine"))
        parts = parts.join(fine, "family").withColumn("p_fail", F.when(F.col("__fine"), F.col("p_fail")))
    long = parts.select("family", "design", "seed", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value")).where("value is not null")
    sides = {d: long.where(F.col("design") == d).select("family", "seed", "metric", F.col("value").alias(c)) for d, c in (("lhs", "x"), ("random", "y"))}
    signs = F.create_map(*[x for m, s in metrics.items() for x in (F.lit(m), F.lit(s))])
    pairs = sides["lhs"].join(sides["random"], ["family", "seed", "metric"]).withColumns({"a": F.col("x") * signs[F.col("metric")], "b": F.col("y") * signs[F.col("metric")]})
    means = pairs.groupBy("family", "metric").agg(F.avg("x").alias("lhs_mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("lhs_sd"), F.avg("y").alias("random_mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("random_sd"))
    return paired_tests(pairs, ["family", "metric"]).where("n >= 2").join(means, ["family", "metric"])


def learning_share(scores: DataFrame, full: str, ablated: str, plain: str) -> DataFrame:
    """(full - ablated) / (full - plain) for each seed."""
    wide = scores.groupBy("seed").pivot("arm", [full, ablated, plain]).agg(F.first("score"))
    gap = F.col(f"`{full}`") - F.col(f"`{plain}`")
    return wide.select("seed", F.when(gap != 0, (F.col(f"`{full}`") - F.col(f"`{ablated}`")) / gap).alias("share"))


def seeds_from_run_order(runs: DataFrame, points: DataFrame) -> DataFrame:
    """Points (arm, pos) get the seed of the run whose interval holds them; arms with unequal totals drop out.

    An arm's positions are cut into as many buckets as it has runs, intervals are split at the buckets' edges, and points
    meet the pieces of their own bucket only: pieces are at most twice the runs.
    """
    w = Window.partitionBy("arm").orderBy("run_index")
    cuts = runs.withColumn("stop", F.sum("n_evaluations").over(w)).withColumn("start", F.col("stop") - F.col("n_evaluations")).where("stop > start")
    arms = runs.groupBy("arm").agg(F.sum("n_evaluations").alias("n"), F.count("*").alias("n_runs")).join(points.groupBy("arm").agg(F.count("*").alias("m")), "arm").where("n = m")
    arms = arms.select("arm", F.ceil(F.col("n") / F.col("n_runs")).alias("__width"))
    bucket = lambda c: F.floor(c / F.col("__width"))
    pieces = cuts.join(arms, "arm").withColumn("__bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop") - 1)))).select("arm", "__bucket", "seed", "start", "stop")
    held = points.join(arms, "arm").withColumn("__bucket", bucket(F.col("pos"))).drop("__width")
    return held.join(pieces, ["arm", "__bucket"]).where("pos >= start and pos < stop").drop("start", "stop", "__bucket")


def outside_share(points: DataFrame, lower: list[float], upper: list[float]) -> DataFrame:
    """Share of points out of bounds, by arm."""
    out = F.lit(False)
    for i, (lo, hi) in enumerate(zip(lower, upper)):
        out = out | (F.col("theta")[i] < lo) | (F.col("theta")[i] > hi)
    return points.groupBy("arm").agg(F.avg(out.cast("double")).alias("outside"))


def same_margins(left: DataFrame, right: DataFrame, atol: float = 1e-9) -> DataFrame:
    """Breaches of seed-wise multiset equality of margins for each arm: places, in the order of margins (nulls first), at
    which the two copies differ or only one has a row.

    Equal margins of an arm and seed are one stretch of places, found by one range sort over all stretches, so that no
    task holds a whole arm and seed. Places that agree are where stretches of margins within ``atol`` of each other meet.
    """
    sides = left.select(F.lit(0).alias("side"), "arm", "seed", "margin").unionByName(right.select(F.lit(1).alias("side"), "arm", "seed", "margin"))
    stretches = sides.groupBy("side", "arm", "seed", "margin").agg(F.count("*").alias("n"))
    placed = stored(prefix_sums(stretches.select(F.struct("side", "arm", "seed", "margin").alias("key"), "n"), "key", "n").select("key.*", "n", "before"))
    sizes = placed.groupBy("side", "arm", "seed").agg(F.min("before").alias("first"), F.sum("n").alias("rows"))
    start = sizes.select(F.struct("side", "arm", "seed").alias("of"), "first")
    held = placed.withColumn("of", F.struct("side", "arm", "seed")).join(start, "of").select("side", "arm", "seed", "margin", "n", (F.col("before") - F.col("first")).alias("start"))
    # cells twice as wide as the tolerance: margins within it are in one cell or in two that touch
    cell = F.rint(F.col("margin") / (2 * atol)) if atol else F.col("margin")
    around = F.array_distinct(F.array(cell - 1, cell, cell + 1)) if atol else F.array(cell)
    of = lambda side, name, at: held.where(F.col("side") == side).select("arm", "seed", at.alias("cell"), F.col("margin").alias(name), F.col("start").alias(f"{name}_start"), (F.col("start") + F.col("n")).alias(f"{name}_end"))
    near = of(0, "x", cell).join(of(1, "y", F.explode(around)), ["arm", "seed", "cell"]).where(F.abs(F.col("x") - F.col("y")) <= atol)
    none = of(0, "x", F.lit(None)).where("x is null").drop("cell").join(of(1, "y", F.lit(None)).where("y is null").drop("cell"), ["arm", "seed"])
    common = F.greatest(F.lit(0), F.least("x_end", "y_end") - F.greatest("x_start", "y_start"))
    agree = near.drop("cell").unionByName(none).groupBy("arm", "seed").agg(F.sum(common).alias("agree"))
    # a row without an arm or a seed agrees with none
    places = sizes.groupBy("arm", "seed").agg(F.when(F.col("arm").isNull() | F.col("seed").isNull(), F.sum("rows")).otherwise(F.max("rows")).alias("places"))
    return places.join(agree, ["arm", "seed"], "left").groupBy("arm").agg(F.sum(F.col("places") - F.coalesce("agree", F.lit(0))).alias("n_breaches"))


def compare_leaderboards(a: DataFrame, b: DataFrame, bounds_a: list, bounds_b: list) -> DataFrame:
    """Full outer join on the arm; different bounds are refused."""
    if list(bounds_a) != list(bounds_b):
        raise ValueError("the two leaderboards have different bounds")
    return a.select("arm", F.col("rank").alias("rank_a")).join(b.select("arm", F.col("rank").alias("rank_b")), "arm", "full_outer")
