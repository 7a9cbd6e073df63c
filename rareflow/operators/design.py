"""Designs: generated rows of scenario points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.odd import Scenario, axis_ppf, hash_uniform


def uniform_design(ids: DataFrame, dims: int, ident: str = "point_id", salt: int = 1) -> DataFrame:
    """point_id, u: independent uniforms of [0, 1) from each id."""
    return ids.select(F.col(ident).alias("point_id"), F.array(*[hash_uniform(F.col(ident), salt + j) for j in range(dims)]).alias("u"))


def latin_hypercube(ids: DataFrame, dims: int, design: str, ident: str = "point_id", salt: int = 1, scramble: bool = True) -> DataFrame:
    """design, point_id, u: on every axis of every design, exactly one point in each of its n strata.

    Each axis permutes the strata on its own, by the order of a hash; many designs spread over the cluster by design.
    """
    n = F.count("*").over(Window.partitionBy(design))
    coords = []
    for j in range(dims):
        order = Window.partitionBy(design).orderBy(hash_uniform(F.col(ident), salt + j), F.col(ident))
        inside = hash_uniform(F.col(ident), salt + dims + j) if scramble else F.lit(0.5)
        coords.append((F.row_number().over(order) - 1 + inside) / n)
    return ids.select(F.col(design), F.col(ident).alias("point_id"), F.array(*coords).alias("u"))


#: Rounds of the permutation. More mix better; any number is a bijection.
ROUNDS = 6


def turn(v: Column, salt: Column | int) -> Column:
    """A hash of v to 31 bits; v and salt below 2**31."""
    one = (v * 48271 + salt * F.lit(69621) + 12345) % 2147483647
    return (one * one + v) % 2147483647


def digits(n: int) -> tuple[int, int]:
    """Bases a and b of two digits that reach n numbers, and fewer than a more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(rows: DataFrame, ident: str, n: int, key: int, name: str) -> DataFrame:
    """Adds ``name``: a keyed permutation of 0 .. n - 1 (n below 2**60) of ``ident``, a row at a time, without sort or shuffle.

    The number is two digits, of base a and b. Rounds add a hash of the one digit to the other, modulo its base. What
    leaves the range is permuted on until it is back (cycle walking): at most a times, as fewer than a numbers lie
    outside, so 64 times are all that is needed up to a = 64, and for larger a the chance to need more is below a ** -64.
    """
    a, b = digits(n)
    out = rows.withColumns({"__l": F.floor(F.col(ident) / b) if b == 1 else F.call_function("div", F.col(ident), F.lit(b)), "__r": F.col(ident) % b})
    for r in range(ROUNDS):
        moved = ("__l", (F.col("__l") + turn(F.col("__r"), key * ROUNDS + r)) % a) if r % 2 == 0 else ("__r", (F.col("__r") + turn(F.col("__l"), key * ROUNDS + r)) % b)
        out = out.withColumn(*moved)
    number = lambda s: s["l"] * b + s["r"]

    def step(s: Column, i: Column) -> Column:
        salt = i % ROUNDS + key * ROUNDS
        left = F.when(i % 2 == 0, (s["l"] + turn(s["r"], salt)) % a).otherwise(s["l"])
        right = F.when(i % 2 == 0, s["r"]).otherwise((s["r"] + turn(s["l"], salt)) % b)
        back = s["back"] | ((i % ROUNDS == 0) & (number(s) < n))  # it stays where it came back
        return F.struct(F.when(back, s["l"]).otherwise(left).alias("l"), F.when(back, s["r"]).otherwise(right).alias("r"), back.alias("back"))

    start = F.struct(F.col("__l").alias("l"), F.col("__r").alias("r"), F.lit(False).alias("back"))
    walked = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS * min(a, 64) - 1).cast("long")), start, step, number)
    first = F.col("__l") * b + F.col("__r")
    return out.withColumn(name, F.when(first < n, first).otherwise(walked)).drop("__l", "__r")


def large_latin_hypercube(ids: DataFrame, n: int, dims: int, ident: str = "point_id", salt: int = 1, scramble: bool = True) -> DataFrame:
    """point_id, u: one Latin hypercube of n points from ids 0 .. n - 1: each axis has exactly one point in each n-th.

    Every row finds its strata by itself, so the design may have any size.
    """
    rows = ids.select(F.col(ident).cast("long").alias("point_id"))
    for j in range(dims):
        rows = permuted(rows, "point_id", n, salt + j, f"__s{j}")
    inside = [hash_uniform(F.col("point_id"), salt + dims + j) if scramble else F.lit(0.5) for j in range(dims)]
    return rows.select("point_id", F.array(*[(F.col(f"__s{j}") + inside[j]) / n for j in range(dims)]).alias("u"))


def to_bounds(u: Column, lower: list[float], upper: list[float]) -> Column:
    return F.array(*[F.lit(lo) + u[i] * (hi - lo) for i, (lo, hi) in enumerate(zip(lower, upper, strict=True))])


def to_unit(theta: Column, lower: list[float], upper: list[float]) -> Column:
    """The unit cube; an axis without width counts as one wide."""
    return F.array(*[(theta[i] - lo) / ((hi - lo) or 1.0) for i, (lo, hi) in enumerate(zip(lower, upper, strict=True))])


def through_odd(u: Column, scenario: Scenario) -> Column:
    """Unit points through the marginals' inverse CDFs."""
    return F.array(*[axis_ppf(a, u[i]) for i, a in enumerate(scenario.axes)])


def payload(theta: Column, names: list[str], defaults: dict[str, int] | None = None) -> Column:
    """Integer payload of a scenario, rounded half to even; missing entries take their default."""
    return F.struct(*[F.coalesce(F.bround(F.get(theta, F.lit(i)), 0).cast("int"), F.lit((defaults or {}).get(n)).cast("int")).alias(n) for i, n in enumerate(names)])


def with_nominal(design: DataFrame, scenario: Scenario) -> DataFrame:
    """Adds the middle of the box as a row of its own, flagged so that rates can leave it out."""
    middle = F.array(*[F.lit((lo + hi) / 2) for lo, hi in zip(scenario.lower, scenario.upper)])
    nominal = design.sparkSession.range(1).select(F.lit(-1).cast("long").alias("point_id"), middle.alias("theta"), F.lit(True).alias("is_nominal"))
    return design.select("point_id", "theta", F.lit(False).alias("is_nominal")).unionByName(nominal)


def sweep_grid(spark: SparkSession, angles: list[float], speeds: list[float], samples: int) -> DataFrame:
    """Every (angle, speed) cell times ``samples`` points; the lists are small parameters of the sweep."""
    cell = F.explode(F.array(*map(F.lit, angles))).alias("angle_max")
    grid = spark.range(1).select(cell).select("angle_max", F.explode(F.array(*map(F.lit, speeds))).alias("speed_max"))
    return grid.select("angle_max", "speed_max", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))


def detection_rate(points: DataFrame, hit: Column, by: str = "design", rep: str = "rep") -> DataFrame:
    """Share of replicated designs with at least one point in a region."""
    return points.groupBy(by, rep).agg(F.bool_or(hit).alias("found")).groupBy(by).agg(F.avg(F.col("found").cast("double")).alias("detection"), F.count("*").alias("n_reps"))


def execution_plan(arms: DataFrame, seeds: DataFrame, mode: str) -> DataFrame:
    """(arm, seed) tasks in sequential, interleaved or shuffled order; run_index from 0. Arms and seeds are small."""
    order = {"sequential": ["arm_pos", "seed_pos"], "interleaved": ["seed_pos", "arm_pos"]}.get(mode) or [F.xxhash64("arm_pos", "seed_pos"), "arm_pos", "seed_pos"]
    tasks = arms.join(F.broadcast(seeds), F.lit(True))
    return tasks.withColumn("run_index", F.row_number().over(Window.orderBy(*order)) - 1)


def known_detection(volume: Column, n: Column) -> Column:
    """The exact chance that n independent draws find a region of this volume."""
    return 1 - F.pow(1 - volume, n)


def repaired(theta: Column, low: int, high: int) -> Column:
    """Sweep points whose lower speed is not below the upper one get it set 1e-6 below."""
    return F.transform(theta, lambda x, i: F.when(i == low, F.least(x, F.get(theta, F.lit(high)) - 1e-6)).otherwise(x))


def boundary_grid(spark: SparkSession, scenario: Scenario, x: int, y: int, steps: int, speeds: tuple[int, int] | None = None) -> DataFrame:
    """theta over a grid of two axes, all others at the operational median; the lower speed never above the upper one."""
    lo, hi = scenario.lower, scenario.upper
    ticks = lambda a: F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.lit(lo[a]) + k * (hi[a] - lo[a]) / max(1, steps - 1)))
    grid = spark.range(1).select(ticks(x).alias("gx")).select("gx", ticks(y).alias("gy"))
    value = [F.col("gx") if i == x else F.col("gy") if i == y else axis_ppf(a, F.lit(0.5)) for i, a in enumerate(scenario.axes)]
    if speeds:
        value[speeds[0]] = F.least(value[speeds[0]], value[speeds[1]])
    return grid.select("gx", "gy", F.array(*value).alias("theta"))


def centred_discrepancy(points: DataFrame, dims: int, design: str) -> DataFrame:
    """Centred L2 discrepancy of each design (design, point_id, u): smaller is more even. Pairs meet inside a design only,
    which is quadratic in its points, as the measure is; designs spread over the cluster."""
    mid = [F.abs(F.col(f"x{i}") - 0.5) for i in range(dims)]
    wide = points.select(design, *[F.col("u")[i].alias(f"x{i}") for i in range(dims)])

    def product(terms: list[Column]) -> Column:
        out = F.lit(1.0)
        for t in terms:
            out = out * t
        return out

    own = wide.groupBy(design).agg(F.count("*").alias("n"), F.sum(product([1 + 0.5 * m - 0.5 * m * m for m in mid])).alias("single"))
    other = wide.select(design, *[F.col(f"x{i}").alias(f"y{i}") for i in range(dims)])
    terms = [1 + 0.5 * F.abs(F.col(f"x{i}") - 0.5) + 0.5 * F.abs(F.col(f"y{i}") - 0.5) - 0.5 * F.abs(F.col(f"x{i}") - F.col(f"y{i}")) for i in range(dims)]
    double = wide.join(other, design).groupBy(design).agg(F.sum(product(terms)).alias("double"))
    value = math.pow(13 / 12, dims) - 2 / F.col("n") * F.col("single") + F.col("double") / (F.col("n") * F.col("n"))
    return own.join(double, design).select(design, "n", value.alias("discrepancy"))
