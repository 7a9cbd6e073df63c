"""Rates, severity and rarity of evaluated points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import exact_quantiles, prefix_sums

Z = 1.96


def failed(margin: Column, threshold: float = 0.0) -> Column:
    """Strictly below the threshold; null for an invalid point."""
    return margin < threshold


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's 95 % interval; null where n is 0."""
    p = k / n
    centre, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), (centre - half) / scale)), F.when(some, F.least(F.lit(1.0), (centre + half) / scale))


def failure_rate(points: DataFrame, by: list[str], threshold: float = 0.0) -> DataFrame:
    """n_valid, n_invalid, n_failures, p and Wilson bounds for each group."""
    got = points.groupBy(*by).agg(F.count("margin").alias("n_valid"), F.count_if(F.col("margin").isNull()).alias("n_invalid"), F.count_if(failed(F.col("margin"), threshold)).alias("n_failures"))
    n = F.col("n_valid").cast("double")
    lo, hi = wilson(F.col("n_failures").cast("double"), F.when(n > 0, n))
    return got.withColumns({"p": F.col("n_failures") / F.when(n > 0, n), "p_lo": lo, "p_hi": hi})


def severity_top(points: DataFrame, by: str, fraction: float, ident: str = "point_id", survival: str | None = None) -> DataFrame:
    """The worst ``fraction`` of each group's failures, at least one: ties go to the shorter survival, then the smaller id.

    The group's k and a bound on its margin come first, so that only failures near the top are ranked.
    """
    fails = points.where(failed(F.col("margin")))
    bound = fails.groupBy(by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(fraction))).alias("k"), F.percentile_approx("margin", min(1.0, fraction + 0.001), 5000).alias("most"), F.min("margin").alias("least"))
    near = fails.join(bound, by).where(F.col("margin") <= F.greatest("most", "least"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("margin", *([survival] if survival else []), ident))
    return near.withColumn("rank", rank).where(F.col("rank") <= F.col("k")).drop("k", "most", "least")


def rare_summary(theta: Column, names: list[str]) -> Column:
    """Name to value of a rare point, rounded to four places."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(theta, lambda x: F.round(x, 4)))


def rarity_cut(reference: DataFrame, log_density: Column, q: float = 0.10) -> float:
    """The q-quantile of the finite log densities of a reference sample, interpolated."""
    finite = reference.select(log_density.alias("lf")).where(F.col("lf") > float("-inf"))
    row = exact_quantiles(finite, F.col("lf"), {"cut": q}, []).first()
    return row["cut"] if row else None


def operational_percentile(queries: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Each distinct query value and the share (in percent) of reference values strictly below it.

    Both sides are counted by value first, then one range sort and prefix sums give the counts below.
    """
    both = queries.select(F.col(value).alias("v"), F.lit(0).alias("n"), F.lit(True).alias("asked")).unionByName(reference.select(F.col(value).alias("v"), F.lit(1).alias("n"), F.lit(False).alias("asked")))
    counts = both.groupBy("v").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    total = F.greatest(reference.agg(F.count("*").alias("total")).first()["total"] * F.lit(1.0), F.lit(1.0))
    return prefix_sums(counts, "v", "n").where("asked").select(F.col("v").alias(value), (F.col("before") * 100.0 / total).alias("odd_percentile"))


def estimator_accuracy(points: DataFrame, rep: str, truth: float) -> DataFrame:
    """Over replicates: number, mean and bias of the failure rate, coverage of the truth and mean width of the interval,
    relative spread, and how many draws of plain Monte Carlo have that spread, against those of one replicate."""
    per = failure_rate(points, [rep])
    inside = (F.col("p_lo") <= truth) & (F.col("p_hi") >= truth)
    sd, n = F.stddev_pop("p"), F.avg("n_valid")
    return per.agg(
        F.count("*").alias("reps"), F.avg("p").alias("mean_p"), (F.avg("p") - truth).alias("bias"), F.avg(inside.cast("double")).alias("coverage"),
        F.avg(F.col("p_hi") - F.col("p_lo")).alias("mean_width"), (sd / truth).alias("relative_error"), (truth * (1 - truth) / F.when(sd > 0, sd * sd) / n).alias("mc_ratio"))


def rate_by_bin(points: DataFrame, value: Column, lower: float, width: float, bins: int) -> DataFrame:
    """Failure rate in left-closed bins of equal width; values outside drop out."""
    b = F.floor((value - lower) / width).cast("int")
    return failure_rate(points.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)), ["bin"])
