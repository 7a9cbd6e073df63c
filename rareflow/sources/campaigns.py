"""Reading and writing simulator replies, campaigns, plans and backend runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY = "run_id long, road array<array<double>>, positions array<array<double>>, speeds array<double>, xtes array<double>, steerings array<double>, throttles array<double>, elapsedTime double, iterations long, predictSeconds double, stepSeconds double"
PLAN = "alpha double, metric string, hypotheses array<struct<id:string,a:string,b:string,direction:string,rationale:string>>"
DIRECTIONS = ("a>b", "b>a", "two-sided")


def reply_steps(replies: DataFrame) -> DataFrame:
    """One row for each step of each reply; a reply without steps keeps one row of nulls."""
    zipped = F.arrays_zip("positions", "xtes", "steerings", "speeds", "throttles")
    rows = replies.select("run_id", F.posexplode_outer(zipped).alias("step", "s"))
    return rows.select("run_id", "step", F.get("s.positions", F.lit(0)).alias("x"), F.get("s.positions", F.lit(1)).alias("y"), F.col("s.xtes").alias("xte"), F.col("s.steerings").alias("steering"), F.col("s.speeds").alias("speed_kmh"), F.col("s.throttles").alias("throttle"))


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    return reply_steps(spark.read.schema(REPLY).json(path))


def read_campaign(spark: SparkSession, path: str) -> DataFrame:
    """Long evaluations; a campaign without seeds gets null seeds, NaN margins become null."""
    rows = spark.read.parquet(path)
    if "seed" not in rows.columns:
        rows = rows.withColumn("seed", F.lit(None).cast("int"))
    return rows.withColumn("margin", F.nanvl("margin", F.lit(None).cast("double")))


def write_campaign(points: DataFrame, path: str) -> None:
    points.write.partitionBy("campaign", "arm").parquet(path)


def write_regions(regions: DataFrame, names: list[str], path: str) -> None:
    centroid = [F.col("centroid")[i].alias(f"centroid_{n}") for i, n in enumerate(names)]
    regions.select("region", "n", "worst_margin", *centroid, F.array_join(F.array_sort("owners"), "|").alias("found_by")).write.option("header", True).csv(path)


def read_regions(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(region, owner, centroid) from a regions file; empty owners drop."""
    rows = spark.read.option("header", True).csv(path)
    centroid = F.array(*[F.col(f"centroid_{n}").cast("double") for n in names])
    return rows.select("region", F.explode(F.split("found_by", r"\|")).alias("owner"), centroid.alias("centroid")).where("owner <> ''")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, a, b, direction, rationale) of a pre-registered plan; missing keys or an unknown direction are refused."""
    whole = spark.read.schema(PLAN).option("multiLine", True).json(path)
    for missing in whole.select(*[F.col(k).isNull().alias(k) for k in ("alpha", "metric", "hypotheses")], (F.size("hypotheses") == 0).alias("any hypothesis")).collect():
        absent = [k for k, gone in missing.asDict().items() if gone]
        if absent:
            raise ValueError(f"the plan has no {', '.join(absent)}")
    rows = whole.select(F.posexplode("hypotheses").alias("pos", "h")).select("pos", "h.*")
    wrong = rows.where(F.col("id").isNull() | F.col("a").isNull() | F.col("b").isNull() | ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False))).limit(1).collect()
    if wrong:
        raise ValueError(f"plan hypothesis {wrong[0]['pos']} is not valid")
    return rows


def read_backend_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each scenario of each backend file; a null qoi is invalid unless the file says otherwise."""
    schema = "backend string, speed_scale double, theta array<array<double>>, qoi array<double>, valid array<boolean>, control_hz array<double>, meters_per_step array<double>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    checked = F.when(F.size("theta") != F.size("qoi"), F.raise_error(F.lit("theta and qoi differ in length")).cast("array<array<double>>")).otherwise(F.col("theta"))
    rows = rows.withColumn("theta", checked).select("backend", "speed_scale", F.posexplode(F.arrays_zip("theta", "qoi", "valid", "control_hz", "meters_per_step")).alias("scenario_idx", "r"))
    return rows.select("backend", "speed_scale", "scenario_idx", "r.theta", F.col("r.qoi").alias("margin"), F.coalesce("r.valid", F.col("r.qoi").isNotNull()).alias("valid"), "r.control_hz", "r.meters_per_step")


def check_metadata(meta: DataFrame, keys: list[str]) -> None:
    """All campaigns must agree on the keys."""
    counts = meta.agg(*[F.count_distinct(F.struct(k)).alias(k) for k in keys]).first()
    for k in keys:
        if counts[k] > 1:
            raise ValueError(f"the campaigns differ in {k}")


def write_backend_runs(runs: DataFrame, path: str) -> None:
    """One JSON object for each backend, its scenarios in order; an invalid margin is a null qoi."""
    fields = ("theta", "margin", "valid", "control_hz", "meters_per_step")
    held = runs.groupBy("backend", "speed_scale").agg(F.array_sort(F.collect_list(F.struct("scenario_idx", *fields))).alias("r"))
    held.select("backend", "speed_scale", *[F.col(f"r.{f}").alias("qoi" if f == "margin" else f) for f in fields]).write.option("ignoreNullFields", False).json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """A per-run table as CSV with a header; arrays become bracketed text."""
    flat = [F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ","), F.lit("]")).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.option("header", True).csv(path)


def write_summary(points: DataFrame, path: str) -> None:
    """A campaign's summary as JSON lines: one for each arm, with its seeds."""
    points.groupBy("arm").agg(F.count("*").alias("n_points"), F.count("margin").alias("n_valid"), F.count_if(F.col("margin") < 0).alias("n_failures"), F.min("margin").alias("worst_margin"), F.sort_array(F.collect_set("seed")).alias("seeds")).write.json(path)


def merge_campaigns(first: DataFrame, second: DataFrame, arms: list[str] | None = None) -> DataFrame:
    """The first campaign's arms, and the second's other arms.

    An arm that both have must have the same margins, seed by seed; a differing copy is refused, and so is one whose
    points carry no seeds, because it cannot be verified.
    """
    from ..operators.ranking import same_margins

    second = second.where(F.col("arm").isin(*arms)) if arms else second
    # one row an arm, which goes to the points: a join that sorts by arm would hold a whole arm in one task
    shared = F.broadcast(first.select("arm").distinct().join(second.select("arm").distinct(), "arm"))
    mine, theirs = (c.join(shared, "arm", "left_semi") for c in (first, second))
    blind = mine.unionByName(theirs, allowMissingColumns=True).where("seed is null").select("arm").limit(1).collect()
    if blind:
        raise ValueError(f"arm {blind[0]['arm']} is in both campaigns and has no seeds: its copies cannot be verified")
    breach = same_margins(mine, theirs).where("n_breaches > 0").limit(1).collect()
    if breach:
        raise ValueError(f"the campaigns differ in {breach[0]['n_breaches']} margins of arm {breach[0]['arm']}")
    return first.unionByName(second.join(shared, "arm", "left_anti"))
