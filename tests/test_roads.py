"""Places on a road, headings, parity and curvature on hand-made polylines."""

import math

import pytest
from pyspark.sql import functions as F

from rareflow.operators import roads

SCHEMA = "run_id long, xy array<struct<x: double, y: double>>"


@pytest.fixture
def corner(spark):
    return spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), (2, [(0.0, 0.0)])], SCHEMA)


def test_frame_sides_and_ends(spark, corner):
    at = spark.createDataFrame([(1, 5.0, 1.0, 0.0), (1, 5.0, -1.0, 0.0), (1, -3.0, 0.0, 0.0), (1, 10.0, 14.0, math.pi), (2, 1.0, 1.0, 0.0)], "run_id long, px double, py double, yaw double")
    got = {(r.px, r.py): r for r in roads.road_frame(at, corner).collect()}
    assert len(got) == 4  # a road of one vertex has no frame
    assert got[5.0, 1.0].lateral == 1 and got[5.0, -1.0].lateral == -1 and got[5.0, 1.0].s == 5
    assert got[-3.0, 0.0].before_start and not got[5.0, 1.0].before_start
    end = got[10.0, 14.0]
    assert end.beyond_end and end.s == 20 and abs(end.heading_error - math.pi / 2) < 1e-12


def test_steps_do_not_build_their_road(spark):
    keys, at = (spark.range(3).select(F.col("id").alias("run_id"), *more) for more in ((), (F.lit(5.0).alias("px"), F.lit(1.0).alias("py"), F.lit(0.0).alias("yaw"))))
    made = keys.select("run_id", F.expr("transform(sequence(0L, run_id), i -> named_struct('x', i * 10D, 'y', 0D))").alias("xy"))
    got = roads.road_frame(at, made)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("as double) * 10.0") == 1  # once for each road, not for each step
    assert sorted(r.run_id for r in got.collect()) == [1, 2] and {r.lateral for r in got.collect()} == {1.0}
    parts = roads.headings(at.withColumn("step", F.lit(0)).drop("yaw"), made, ["step"])
    assert [r.yaw for r in parts.collect()] == [0.0, 0.0]


def test_nearest_with_unknown_places_ties_and_long_batches(spark, corner):
    nan, odd = float("nan"), "run_id long, px double, py double, yaw double"
    at = spark.createDataFrame([(1, None, 1.0, 0.0), (1, nan, 1.0, 0.0), (1, 9.0, 1.0, 0.0)], odd)
    got = {r.px if r.px == r.px else "nan": r.near for r in roads.nearest(at, corner).collect()}
    assert tuple(got[None]) == (None, 0, 0.0) and got["nan"].i == 0 and got["nan"].t == 1 and math.isnan(got["nan"].d)
    assert tuple(got[9.0]) == (1.0, 0, 0.9)
    many = spark.range(5000).select(F.lit(1).cast("long").alias("run_id"), (F.col("id") % 11).cast("double").alias("px"), F.lit(0.5).alias("py"))
    assert {(r.px, r.near.d) for r in roads.nearest(many, corner).collect()} == {(float(x), min(0.5, 10.0 - x)) for x in range(11)}


def test_headings_carry_over_a_stop(spark, corner):
    steps = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.0, 1.0), (1, 3, 1.0, 1.0)], "run_id long, step int, px double, py double")
    got = [r.yaw for r in roads.headings(steps, corner, ["step"]).orderBy("step").collect()]
    assert got == [0.0, math.pi / 2, math.pi / 2, 0.0]


def test_parity_needs_a_built_road(spark, corner):
    ref = spark.createDataFrame([(k, [(float(i), 0.0) for i in range(20)]) for k in (1, 2, 3)], SCHEMA)
    built = spark.createDataFrame([(1, [(float(i), 0.05) for i in range(20)]), (2, [(float(i), 0.2) for i in range(20)])], SCHEMA)
    got = {r.run_id: r for r in roads.parity(ref, built).collect()}
    assert got[1].ok and abs(got[1].max_dev - 0.05) < 1e-9
    assert not got[2].ok and not got[3].ok and got[3].max_dev is None


def test_curvature_of_a_circle_and_a_line(spark):
    circle = [(5 * math.cos(i / 5), 5 * math.sin(i / 5)) for i in range(12)]
    rows = spark.createDataFrame([(1, circle), (2, [(float(i), 2.0 * i) for i in range(12)]), (3, circle[:5])], SCHEMA)
    got = {r.run_id: r.curvature for r in roads.curvature(rows).collect()}
    assert abs(got[1] - 0.2) < 1e-9 and got[2] == 0 and got[3] == 0
