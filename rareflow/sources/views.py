"""Canonical tables of the library as views over the driver's tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.odd import Axis, Scenario, angle_axis, speed_axis

SCENARIO = Scenario((angle_axis("quantity", 1.0, 50.0), speed_axis("discount", 0.0, 0.10), Axis("tax", 0.0, 0.08)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as evaluated points: six arms, twelve seeds, three parameters; line 7 is invalid."""
    li = table(spark, sf_dir, "lineitem")
    family = F.when(F.col("l_returnflag") == "A", "active_boundary").when(F.col("l_returnflag") == "N", "cross_entropy").otherwise("plain_sampling")
    design = F.when(F.col("l_linestatus") == "F", "lhs").otherwise("random")
    q, d, t = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")
    return li.select(
        F.concat(family, F.lit("["), design, F.lit("]")).alias("arm"), (F.col("l_suppkey") % 12).cast("int").alias("seed"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.array(q.cast("double"), d / 100.0, t / 100.0).alias("theta"),
        F.when(F.col("l_linenumber") != 7, (9000 - (q * 100 + d * 400 + t * 437)) / 10000.0).alias("margin"),
    )


EVALUATIONS = """ev AS (SELECT CASE l_returnflag WHEN 'A' THEN 'active_boundary' WHEN 'N' THEN 'cross_entropy' ELSE 'plain_sampling' END
 || '[' || CASE WHEN l_linestatus = 'F' THEN 'lhs' ELSE 'random' END || ']' AS arm, CAST(l_suppkey % 12 AS INTEGER) AS seed,
 l_orderkey * 10 + l_linenumber AS point_id, CAST(l_quantity AS DOUBLE) AS t0, CAST(round(l_discount * 100) AS BIGINT) / 100.0 AS t1, CAST(round(l_tax * 100) AS BIGINT) / 100.0 AS t2,
 CASE WHEN l_linenumber <> 7 THEN (9000 - (CAST(l_quantity AS BIGINT) * 100 + CAST(round(l_discount * 100) AS BIGINT) * 400 + CAST(round(l_tax * 100) AS BIGINT) * 437)) / 10000.0::DOUBLE END AS margin FROM lineitem)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry steps, one run for each user."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    xte = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), (F.col("value") - 50) / 40))
    return ev.select(F.col("user_id").alias("run_id"), step.alias("step"), xte.alias("xte"), (((F.col("event_id") * 37) % 201 - 100) / 100.0).alias("steering"), (F.col("value") % 60).alias("speed_kmh"), "ts")


TELEMETRY = """st AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
 least(3.0, greatest(-3.0, (value - 50) / 40)) AS xte, ((event_id * 37) % 201 - 100) / 100.0::DOUBLE AS steering, value % 60 AS speed_kmh, ts FROM events)"""


def backend_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as two backends with different deterministic margins."""
    p = table(spark, sf_dir, "part").where("p_partkey is not null")
    both = p.withColumn("backend", F.explode(F.array(F.lit("fast"), F.lit("full"))))
    price = (F.round(F.col("p_retailprice") * 100).cast("long") * 31) % 997
    margin = F.when(F.col("backend") == "fast", (F.col("p_size") * 20 - 200) / 1000.0).otherwise((F.col("p_size") * 20 - 400 + price % 300) / 1000.0)
    valid = ~((F.col("backend") == "full") & (F.col("p_partkey") % 13 == 0))
    return both.select("backend", F.col("p_partkey").alias("scenario_idx"), F.array(F.col("p_size").cast("double")).alias("theta"), F.when(valid, margin).alias("margin"), valid.alias("valid"), ((F.col("p_partkey") * 7) % 40 / 2.0 + F.when(F.col("backend") == "fast", 10).otherwise(5)).alias("control_hz"))


BACKENDS = """br AS (SELECT backend, p_partkey AS scenario_idx, CAST(p_size AS DOUBLE) AS t0, NOT (backend = 'full' AND p_partkey % 13 = 0) AS valid,
 CASE WHEN backend = 'full' AND p_partkey % 13 = 0 THEN NULL WHEN backend = 'fast' THEN (p_size * 20 - 200) / 1000.0::DOUBLE ELSE (p_size * 20 - 400 + ((CAST(round(p_retailprice * 100) AS BIGINT) * 31) % 997) % 300) / 1000.0::DOUBLE END AS margin,
 (p_partkey * 7) % 40 / 2.0::DOUBLE + CASE WHEN backend = 'fast' THEN 10 ELSE 5 END AS control_hz FROM part, (VALUES ('fast'), ('full')) b(backend) WHERE p_partkey IS NOT NULL)"""


def region_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: four components in a fixed unit scaling; a fixed rule fails some."""
    e = table(spark, sf_dir, "embeddings")
    u = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("embedding")[i].cast("double") + 0.5))) for i in range(4)]
    return e.select(F.col("vec_id").alias("point_id"), F.array(*u).alias("u"), F.concat(F.lit("arm"), F.col("label") % 3).alias("owner"), (u[0] - 0.5).alias("margin"))


POINTS = """pt AS (SELECT vec_id AS point_id, 'arm' || (label % 3) AS owner, least(1.0, greatest(0.0, embedding[1]::DOUBLE + 0.5)) AS u0, least(1.0, greatest(0.0, embedding[2]::DOUBLE + 0.5)) AS u1,
 least(1.0, greatest(0.0, embedding[3]::DOUBLE + 0.5)) AS u2, least(1.0, greatest(0.0, embedding[4]::DOUBLE + 0.5)) AS u3, least(1.0, greatest(0.0, embedding[1]::DOUBLE + 0.5)) - 0.5 AS margin FROM embeddings)"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as run rows of arms (priorities) and seeds."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("arm"), F.substring("o_orderpriority", 1, 1), F.lit("["), F.when(F.col("o_orderkey") % 2 == 0, "lhs").otherwise("random"), F.lit("]")).alias("arm"), (F.col("o_custkey") % 12).cast("int").alias("seed")).agg(
        F.count("*").alias("n_evaluations"), F.count_if(F.col("o_totalprice") > 400000).alias("n_failures"), F.min("o_totalprice").alias("worst_margin"), F.avg((F.col("o_totalprice") > 400000).cast("double")).alias("p_fail"))


RUNS = """rs AS (SELECT 'arm' || substring(o_orderpriority, 1, 1) || '[' || CASE WHEN o_orderkey % 2 = 0 THEN 'lhs' ELSE 'random' END || ']' AS arm, CAST(o_custkey % 12 AS INTEGER) AS seed,
 count(*) AS n_evaluations, count(*) FILTER (o_totalprice > 400000) AS n_failures, min(o_totalprice) AS worst_margin, avg(CASE WHEN o_totalprice > 400000 THEN 1.0::DOUBLE ELSE 0.0 END) AS p_fail FROM orders GROUP BY 1, 2)"""


def roads(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """suppliers as roads of twelve vertices; ``shift`` moves some of them sideways, as a second build would."""
    y = f"((s_suppkey * 31 + i * i * 17) % 23 - 11) * 0.5D + ((s_suppkey + i) % 5) * {shift!r}D"
    return table(spark, sf_dir, "supplier").where("s_suppkey is not null").select(F.col("s_suppkey").alias("run_id"), F.expr(f"transform(sequence(0L, 11L), i -> named_struct('x', i * 10D, 'y', {y}))").alias("xy"))


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as vehicle poses on the supplier's road."""
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey is not null")
    return rows.select(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("tick"), F.col("l_linenumber").alias("part"), (F.col("l_quantity").cast("long") * F.lit(2.25)).alias("px"),
                       (F.round(F.col("l_discount") * 100).cast("long") - F.lit(5.0)).alias("py"), ((F.col("l_orderkey") % 628 - 314) / F.lit(100.0)).alias("yaw"))


ROADS = """ve AS (SELECT s_suppkey AS run_id, i, i * 10.0::DOUBLE AS x, ((s_suppkey * 31 + i * i * 17) % 23 - 11) * 0.5::DOUBLE AS y, ((s_suppkey * 31 + i * i * 17) % 23 - 11) * 0.5::DOUBLE + ((s_suppkey + i) % 5) * 0.03::DOUBLE AS y2 FROM supplier, range(12) r(i) WHERE s_suppkey IS NOT NULL),
sg AS (SELECT *, sum(len) OVER (PARTITION BY run_id ORDER BY i) - len AS s0 FROM (SELECT a.run_id, a.i, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len FROM ve a JOIN ve b ON a.run_id = b.run_id AND b.i = a.i + 1))"""
DRIVES = """dr AS (SELECT row_number() OVER () AS rid, l_suppkey AS run_id, l_orderkey AS tick, l_linenumber AS part, CAST(l_quantity AS BIGINT) * 2.25::DOUBLE AS px, CAST(round(l_discount * 100) AS BIGINT) - 5.0::DOUBLE AS py, (l_orderkey % 628 - 314) / 100.0::DOUBLE AS yaw FROM lineitem WHERE l_suppkey IS NOT NULL)"""
NEAREST = """pt AS (SELECT p.*, g.*EXCLUDE (run_id), least(1.0, greatest(0.0, ((px - ax) * dx + (py - ay) * dy) / greatest(dx * dx + dy * dy, 1e-18))) AS t FROM {p} p JOIN sg g USING (run_id)),
pd AS (SELECT *, sqrt((ax + t * dx - px) * (ax + t * dx - px) + (ay + t * dy - py) * (ay + t * dy - py)) AS d FROM pt), nr AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, i) = 1)"""
FRAMES = f"""{ROADS}, {DRIVES}, {NEAREST.format(p='dr')}, fr AS (SELECT *, CASE WHEN dx * (py - (ay + t * dy)) - dy * (px - (ax + t * dx)) < 0 THEN -d ELSE d END AS lat, s0 + t * len AS s, yaw - atan2(dy, dx) AS turn FROM nr)"""
