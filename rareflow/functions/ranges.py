"""Order statistics of large columns without a single sorting task: range sorts, prefix sums, exact quantiles, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that brackets a quantile, steps of its grid, and rows of an interval that are sorted as they are.
ACCURACY, GRID, INSIDE = 5_000, 1_000, 20_000


def ready(spark: SparkSession) -> None:
    """Names a checkpoint folder where the session has none: its own setting first, a folder of ours on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ready(spark)
    return spark.sparkContext.getCheckpointDir()


_STORED: dict[str, DataFrame] = {}


def stored(df: DataFrame) -> DataFrame:
    """The table written once in the checkpoint folder and read back. A checkpoint would compute it twice, and keeps the
    estimated sizes of its plan, which multiply from join to join in a loop; a written table has its own size."""
    ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED[path] = out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in [p for p, t in _STORED.items() if any(t is x for x in tables)]:
        where = _STORED.pop(path).sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(tables[0].sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def prefix_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows with a smaller key. Keys must be distinct.

    One range sort; one number for each sorted partition reaches the driver.
    """
    run = stored(stored(rows).repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    total, starts = 0, {}
    for p, n in sorted((r["p"], r["n"]) for r in run.groupBy(part.alias("p")).agg(F.sum(value).alias("n")).collect()):
        starts[p], total = total, total + (n or 0)
    start = F.create_map(*[F.lit(v) for pair in (starts or {0: 0}).items() for v in pair])[part]
    inside = F.sum(value).over(Window.partitionBy(part).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    return run.withColumn("before", start + F.coalesce(inside, F.lit(0))).drop("__at")


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the average rank of ``value`` over all rows (1 for the smallest); nulls get none."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    ranks = prefix_sums(counts, value, "__n").select(value, (F.col("before") + (F.col("__n") + 1) / 2.0).alias(name))
    return rows.join(ranks, value, "left")


def exact_quantiles(rows: DataFrame, value: Column, shares: dict[str, float], by: list[str], inside: int = INSIDE) -> DataFrame:
    """``by`` and one interpolated quantile for each name, over the rows with a value; for few groups of many rows.

    Each rank that a quantile needs has an open interval of values which holds it. A sketch names two values around the
    rank; counting the rows below, at and between them moves the interval there, or ends the search at one of the two.
    Both values leave the interval, so columns of few values end at once, and each round leaves some hundredth of the
    rows. What at most ``inside`` rows share is sorted, and so are groups that have no more from the start. All counts
    are partial aggregates; the sketch only decides how fast, never what.
    """
    held = rows.select(*by, value.cast("double").alias("__v")).where("__v is not null").withColumn("__g", F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    of = [F.col("__g")[c].alias(c) for c in by]
    if (held.groupBy("__g").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) <= inside:
        return held.groupBy("__g").agg(*[F.percentile("__v", F.lit(q)).alias(name) for name, q in shares.items()]).select(*of, *shares)
    grid = F.percentile_approx("__v", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("grid")
    sizes = stored(held.groupBy("__g").agg(F.count("*").alias("n"), grid))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(shares.values())])).alias("x")
    wanted = sizes.select("__g", "n", "grid", asked).select("__g", "n", "grid", "x.*")
    ranks = wanted.select("__g", "q", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    none = F.lit(None).cast("double")
    first = ranks.select("__g", "rank").distinct().join(sizes, "__g")
    search = stored(first.select("__g", "rank", "grid", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), none.alias("found")))
    within = (F.col("lo").isNull() | (F.col("__v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("__v") < F.col("hi")))
    got = None
    while True:
        few = search.where((F.col("m") <= inside) & F.col("found").isNull())
        order = F.row_number().over(Window.partitionBy("__g", "rank").orderBy("__v"))
        sorted_ = held.join(few.drop("grid"), "__g").where(within).withColumn("__at", order - 1 + F.col("below")).where(F.col("__at") == F.col("rank")).select("__g", "rank", "__v")
        ended = sorted_.unionByName(search.where("found is not null").select("__g", "rank", F.col("found").alias("__v")))
        got = ended if got is None else got.unionByName(ended)
        many = search.where((F.col("m") > inside) & F.col("found").isNull())
        if many.isEmpty():
            break
        place = F.floor((F.col("rank") - F.col("below") + F.lit(0.5)) / F.col("m") * GRID).cast("int")
        ends = many.select("__g", "rank", "lo", "hi", "below", "m", F.get("grid", F.greatest(place - 3, F.lit(0))).alias("p1"), F.get("grid", F.least(place + 4, F.lit(GRID))).alias("p2"))
        v, keys = F.col("__v"), ["__g", "rank", "lo", "hi", "below", "m", "p1", "p2"]
        counts = held.join(ends, "__g").where(within).groupBy(*keys).agg(
            F.count_if(v < F.col("p1")).alias("lt1"), F.count_if(v <= F.col("p1")).alias("le1"), F.count_if(v < F.col("p2")).alias("lt2"), F.count_if(v <= F.col("p2")).alias("le2"))
        r = F.col("rank") - F.col("below")
        left, first_end, middle, last_end = r < F.col("lt1"), r < F.col("le1"), r < F.col("lt2"), r < F.col("le2")
        moved = counts.select(
            "__g", "rank",
            F.when(left, F.col("lo")).when(middle, F.col("p1")).otherwise(F.col("p2")).alias("lo"), F.when(left, F.col("p1")).when(middle, F.col("p2")).otherwise(F.col("hi")).alias("hi"),
            (F.col("below") + F.when(left, 0).when(middle, F.col("le1")).otherwise(F.col("le2"))).alias("below"),
            F.when(left, F.col("lt1")).when(middle, F.col("lt2") - F.col("le1")).otherwise(F.col("m") - F.col("le2")).alias("m"),
            F.when(left, None).when(first_end, F.col("p1")).when(middle, None).when(last_end, F.col("p2")).alias("found"))
        moved = stored(moved)
        still = moved.where((F.col("m") > inside) & F.col("found").isNull())
        sketch = held.join(still, "__g").where(within).groupBy("__g", "rank").agg(grid)
        search = moved.withColumn("grid", F.lit(None).cast("array<double>")) if still.isEmpty() else stored(moved.join(sketch, ["__g", "rank"], "left"))
    two = ranks.join(got, ["__g", "rank"]).groupBy("__g", "q", "at").agg(F.min("__v").alias("a"), F.max("__v").alias("b"))
    share = F.col("at") - F.floor("at")
    wide = two.groupBy("__g").agg(*[F.max(F.when(F.col("q") == i, F.col("a") + share * (F.col("b") - F.col("a")))).alias(name) for i, name in enumerate(shares)])
    return stored(wide.select(*of, *shares))
