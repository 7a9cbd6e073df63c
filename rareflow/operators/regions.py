"""Failure regions: density clusters of failing points in the unit cube, and how arms share them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odd import Scenario, axis_cdf
from ..functions.ranges import exact_quantiles
from .density import dbscan, distance, neighbour_distances


def eps_pairs(points: DataFrame, eps: float, axes: int = 2, by: Column | None = None) -> DataFrame:
    """(a, b, dist) with a < b and distance <= eps: a grid of side eps on the first axes, then the exact distance.

    Each point goes to its own cell as a, and to the neighbouring cells as b, so every near pair meets once. Points with
    different values of ``by`` (a LONG) never meet.
    """
    lead = [] if by is None else [by]
    cells = [F.floor(F.col("u")[i] / eps) for i in range(axes)]
    left = points.select(F.col("point_id").alias("a"), F.col("u").alias("ua"), F.array(*lead, *cells).alias("cell"))
    shifts = F.array(*[F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=axes)])
    right = points.select(F.col("point_id").alias("b"), F.col("u").alias("ub"), F.explode(F.transform(shifts, lambda s: F.array(*lead, *[cells[i] + s[i] for i in range(axes)]))).alias("cell"))
    return left.join(right, "cell").where("a < b").withColumn("dist", distance(F.col("ua"), F.col("ub"))).where(F.col("dist") <= eps).select("a", "b", "dist")


def estimated_eps(points: DataFrame, dims: int, k: int = 2, digits: int | None = None) -> float:
    """The median distance to the k-th nearest other point; sqrt(d) / 4 where there are too few points or it is 0.

    With ``digits`` it is rounded up to so many decimals: the median is itself a distance, and rounding in the last place
    would else decide whether that pair is near.
    """
    row = exact_quantiles(neighbour_distances(points, dims, k), F.col("dist"), {"eps": 0.5}, []).first()
    eps = row["eps"] if row and row["eps"] else math.sqrt(dims) / 4
    return eps if digits is None else math.ceil(eps * 10**digits) / 10**digits


def constraint_text(names: list[str]) -> Column:
    """The interval of each constraining axis of a region record, or that there is none."""
    text = F.transform("constraining_axes", lambda j: F.format_string("%s in [%.2f, %.2f]", F.array(*map(F.lit, names))[j], F.col("box_lower")[j], F.col("box_upper")[j]))
    return F.when(F.size("constraining_axes") == 0, "no axis constrained").otherwise(F.array_join(text, ", "))


def centroid_text(names: list[str]) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size("centroid") - 1), lambda j: F.format_string("%s=%.2f", F.array(*map(F.lit, names))[j], F.col("centroid")[j])), ", ")


def hit_under(scenario: Scenario) -> Column:
    """A draw's chance to hit a region's constraining box under the operational marginals; 1 if no axis is constrained,
    null below four points. The box is in the unit cube of the scenario's bounds."""
    total = F.lit(1.0)
    for i, axis in enumerate(scenario.axes):
        wide = axis.upper - axis.lower
        span = axis_cdf(axis, axis.lower + F.col("box_upper")[i] * wide) - axis_cdf(axis, axis.lower + F.col("box_lower")[i] * wide)
        total = total * F.when(F.array_contains("constraining_axes", i), span).otherwise(1.0)
    return F.when(F.col("n") >= 4, total)


def arm_reports(points: DataFrame, found: DataFrame) -> DataFrame:
    """Evaluations, failures, failure rate, worst margin and regions reached of every owner."""
    n = F.count("margin")
    per = points.groupBy("owner").agg(n.alias("n_evaluations"), F.count_if(F.col("margin") < 0).alias("n_failures"), (F.count_if(F.col("margin") < 0) / F.when(n > 0, n)).alias("failure_rate"), F.min("margin").alias("worst_margin"))
    regions = found.groupBy("owner").agg(F.count("*").alias("n_regions"))
    return per.join(regions, "owner", "left").withColumn("n_regions", F.coalesce("n_regions", F.lit(0)))


def region_records(members: DataFrame, dims: int, pad: float = 0.02) -> DataFrame:
    """One row for each region from (point_id, region, owner, margin, u): size, centroid, padded box, volume, owners."""
    u = F.col("u")
    aggs = [F.count("*").alias("n"), F.min("margin").alias("worst_margin"), F.avg("margin").alias("mean_margin"), F.sort_array(F.collect_set("owner")).alias("owners")]
    for i in range(dims):
        aggs += [F.avg(u[i]).alias(f"c{i}"), F.greatest(F.lit(0.0), F.min(u[i]) - pad).alias(f"lo{i}"), F.least(F.lit(1.0), F.max(u[i]) + pad).alias(f"hi{i}")]
    got = members.groupBy("region").agg(*aggs)
    side = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(dims)]
    volume = side[0]
    for s in side[1:]:
        volume = volume * s
    limit = 0.5 * (F.col("n") - 1) / (F.col("n") + 1)
    tight = F.array(*[F.when((F.col("n") >= 4) & (s < limit), F.lit(i)) for i, s in enumerate(side)])
    hit = F.lit(1.0)
    for i, s in enumerate(side):
        hit = hit * F.when(s < limit, s).otherwise(1.0)
    return got.select(
        "region", "n", "worst_margin", "mean_margin", "owners", F.array(*[F.col(f"c{i}") for i in range(dims)]).alias("centroid"),
        F.array(*[F.col(f"lo{i}") for i in range(dims)]).alias("box_lower"), F.array(*[F.col(f"hi{i}") for i in range(dims)]).alias("box_upper"),
        volume.alias("volume_fraction"), (F.col("n") == 1).alias("is_singleton"), F.filter(tight, lambda x: x.isNotNull()).alias("constraining_axes"), F.when(F.col("n") >= 4, hit).alias("p_hit_uniform"),
    )


def draws_for_half(p: Column) -> Column:
    """Blind draws for an even chance of a hit: inf at p <= 0, 1 at p >= 1, null if p is."""
    return F.when(p.isNull(), None).when(p <= 0, float("inf")).when(p >= 1, 1.0).otherwise(F.log(F.lit(0.5)) / F.log1p(-p))


def hit_chance(p: Column, n: int) -> Column:
    return 1 - F.pow(1 - p, F.lit(n))


def rarest_first(regions: DataFrame) -> DataFrame:
    """Numbers regions from the rarest on; those that cannot be estimated come last. One row for each region."""
    return regions.withColumn("region_no", F.row_number().over(Window.orderBy(F.col("p_hit_uniform").isNull(), "p_hit_uniform", "region")))


def discoveries(members: DataFrame) -> DataFrame:
    return members.select("owner", "region").distinct()


def exclusive_regions(found: DataFrame) -> DataFrame:
    """Regions that one owner alone reached, counted by owner."""
    return found.groupBy("region").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1").groupBy("owner").agg(F.count("*").alias("n_exclusive"))


def overlaps(found: DataFrame) -> DataFrame:
    """Jaccard, shared and one-sided counts of every pair of owners; sizes and shared counts come from one equi-join."""
    size = found.groupBy("owner").agg(F.count("*").alias("n"))
    shared = found.withColumnRenamed("owner", "a").join(found.withColumnRenamed("owner", "b"), "region").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = size.select(F.col("owner").alias("a"), F.col("n").alias("na")).join(F.broadcast(size.select(F.col("owner").alias("b"), F.col("n").alias("nb"))), F.col("a") < F.col("b"))
    got = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return got.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def coverage(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of each owner's points with some point of another owner within the pairs' radius."""
    own = members.select("point_id", "owner")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(own.select(F.col("point_id").alias("b"), F.col("owner").alias("other")), "b").select(F.col("a").alias("point_id"), "other").distinct()
    hits = own.join(near, "point_id").where("owner <> other").groupBy("owner", "other").agg(F.count("*").alias("hit"))
    size = own.groupBy("owner").agg(F.count("*").alias("n"))
    every = size.join(F.broadcast(size.select(F.col("owner").alias("other"))), F.col("owner") != F.col("other"))
    return every.join(hits, ["owner", "other"], "left").select("owner", "other", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("coverage"))


def axis_spread(points: DataFrame) -> DataFrame:
    return points.select(F.posexplode("u").alias("axis", "x")).groupBy("axis").agg((F.max("x") - F.min("x")).alias("spread"))


def shuffled_copies(points: DataFrame, dims: int, copies: int, seed: int = 0) -> DataFrame:
    """(copy, slot, u): ``copies`` clouds with the same marginals, each axis in an order of its own.

    One range sort orders every (copy, axis) by a hash. All have n rows, so a row's place modulo n is its slot in the
    copy; places come from the row counts of the sorted partitions.
    """
    n = points.count()
    axes = points.where("u is not null").select("point_id", F.posexplode("u").alias("axis", "x")).where(F.col("axis") < dims)
    rows = axes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("h", F.xxhash64("point_id", "axis", "copy", F.lit(seed)))
    keys = ["copy", "axis", "h", "point_id"]
    run = rows.checkpoint().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, {}
    for p, count in sorted(run.groupBy(part.alias("p")).count().collect()):  # one number a partition
        starts[p], before = before, before + count
    if not starts:
        return points.sparkSession.createDataFrame([], "copy int, slot long, u array<double>")
    start = F.create_map(*[F.lit(v) for pair in starts.items() for v in pair])
    placed = run.withColumn("slot", (start[part] + row) % n)
    return placed.groupBy("copy", "slot").agg(*[F.max(F.when(F.col("axis") == i, F.col("x"))).alias(f"x{i}") for i in range(dims)]).select("copy", "slot", F.array(*[F.col(f"x{i}") for i in range(dims)]).alias("u"))


def structure_score(points: DataFrame, dims: int, eps: float, min_samples: int = 2, least: int = 4, copies: int = 20, seed: int = 0) -> DataFrame:
    """One row: share of points in groups of ``least`` or more, the same over shuffled copies, z, has_structure.

    ``points``: (point_id, u), distinct ids, no null u. All clouds are clustered in one job. Below 2 * ``least`` points all is zero.
    """
    n = points.count()
    if n < 2 * least:
        return points.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 0.0, False)], "observed double, null_mean double, null_std double, z double, has_structure boolean")
    clouds = points.select(F.lit(0).alias("copy"), F.col("point_id").alias("slot"), "u").unionByName(shuffled_copies(points, dims, copies, seed))
    clouds = clouds.select(F.xxhash64("copy", "slot").alias("point_id"), "copy", "u").checkpoint()
    labels = dbscan(clouds, eps, min_samples, by=F.col("copy").cast("long"))
    sizes = labels.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    inside = labels.join(sizes, "region", "left_semi").join(clouds.select("point_id", "copy"), "point_id").groupBy("copy").agg((F.count("*") / n).alias("share"))
    every = points.sparkSession.range(copies + 1).select(F.col("id").cast("int").alias("copy"))
    shares = every.join(inside, "copy", "left").select("copy", F.coalesce("share", F.lit(0.0)).alias("share"))
    null = F.when(F.col("copy") > 0, F.col("share"))
    got = shares.agg(F.max(F.when(F.col("copy") == 0, F.col("share"))).alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_std"))
    gap = F.col("observed") - F.col("null_mean")
    z = F.when(F.col("null_std") > 1e-12, gap / F.col("null_std")).when(gap <= 0, 0.0).otherwise(99.0)
    return got.withColumn("z", z).withColumn("has_structure", F.col("z") > 2)


def sampler_verdict(arms: DataFrame, found: DataFrame, localised: DataFrame) -> DataFrame:
    """For each family with both designs (arms named ``family[lhs]``, ``family[random+...]``): which reached more localised regions.

    A gap counts from two regions and 30% of the family's on. Of several arms with one family and design, the last name counts.
    """
    form = r"^([^\[]*)\[(lhs|random)(\+.*)?\]$"
    named = arms.where(F.col("owner").rlike(form)).select("owner", F.regexp_extract("owner", form, 1).alias("family"), F.regexp_extract("owner", form, 2).alias("design"))
    chosen = named.groupBy("family", "design").agg(F.max("owner").alias("owner"))
    both = chosen.groupBy("family").agg(F.count("*").alias("designs")).where("designs = 2").select("family")
    reach = found.select("owner", "region").distinct().join(localised.select("region").distinct(), "region").join(F.broadcast(chosen), "owner")
    per = reach.groupBy("family", "region").agg(F.max((F.col("design") == "lhs").cast("int")).alias("l"), F.max((F.col("design") == "random").cast("int")).alias("r"))
    per = per.groupBy("family").agg(F.sum("l").alias("localised_lhs"), F.sum("r").alias("localised_random"), F.count("*").alias("pool"), F.sum(F.col("l") * F.col("r")).alias("shared"))
    got = both.join(per, "family", "left").na.fill(0)
    gap = F.col("localised_lhs") - F.col("localised_random")
    verdict = F.when(F.col("pool") == 0, "n/a").when((F.abs(gap) < 2) | (F.abs(gap) / F.col("pool") < 0.3), "tie").when(gap > 0, "lhs").otherwise("random")
    return got.select("family", "localised_lhs", "localised_random", (F.col("localised_lhs") - F.col("shared")).alias("only_lhs"), (F.col("localised_random") - F.col("shared")).alias("only_random"), verdict.alias("verdict"))


def regime(points: DataFrame, records: DataFrame, has_structure: bool = False) -> DataFrame:
    """One row: smallest axis spread, localised regions and their share of the failures, and whether the regime is rare."""
    local = F.size("constraining_axes") > 0
    spread = axis_spread(points).agg(F.min("spread").alias("min_spread"))
    shares = records.agg(F.count_if(local).alias("n_localised"), F.coalesce(F.sum(F.when(local, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias("localised_share"))
    rare = F.lit(has_structure) | F.coalesce(F.col("min_spread") < 0.9, F.lit(False))
    return spread.crossJoin(shares).select("min_spread", "n_localised", "localised_share", rare.alias("rare_regime"))


def rarest(records: DataFrame, k: int = 5) -> DataFrame:
    """The k regions that are hardest to hit blindly, of those that can be estimated."""
    return records.where("p_hit_uniform is not null").orderBy("p_hit_uniform", "region").limit(k)
