"""Helpers without a query of their own: grids, arms, texts and chances of regions, bands of sweeps, files of campaigns."""

import math

import pytest
from pyspark.sql import functions as F

from rareflow.functions.odd import Axis, Scenario
from rareflow.operators import design, outcomes, regions, sweeps
from rareflow.sources import campaigns

BOX = Scenario((Axis("p", 0.0, 10.0), Axis("q", 0.0, 4.0, "truncnorm", 2.0, 1.0), Axis("r", -1.0, 1.0)))


def phi(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def test_boundary_grid_holds_the_others_at_their_median(spark):
    rows = design.boundary_grid(spark, BOX, 0, 2, 5).collect()
    assert len(rows) == 25
    assert {(r.gx, r.gy) for r in rows} == {(2.5 * i, -1 + 0.5 * j) for i in range(5) for j in range(5)}
    assert all(r.theta[0] == r.gx and r.theta[2] == r.gy and r.theta[1] == pytest.approx(2.0) for r in rows)
    rows = design.boundary_grid(spark, BOX, 0, 2, 3, speeds=(0, 2)).collect()
    assert all(r.theta[0] == min(r.gx, r.gy) for r in rows)


def test_known_detection_and_sweep_grid(spark):
    got = spark.range(1).select(design.known_detection(F.lit(0.1), F.lit(7)).alias("p")).first().p
    assert got == pytest.approx(1 - 0.9**7)
    grid = design.sweep_grid(spark, [10.0, 20.0], [5.0, 6.0, 7.0], 4).collect()
    assert len(grid) == 24 and len({(r.angle_max, r.speed_max) for r in grid}) == 6


def test_hit_under_the_operational_marginals(spark):
    form = "n long, constraining_axes array<int>, box_lower array<double>, box_upper array<double>"
    rows = [(5, [0, 1], [0.2, 0.25, 0.0], [0.5, 0.75, 1.0]), (5, [], [0.0] * 3, [1.0] * 3), (3, [0], [0.2] * 3, [0.5] * 3)]
    got = [r.p for r in spark.createDataFrame(rows, form).select(regions.hit_under(BOX).alias("p")).collect()]
    normal = (phi(1.0) - phi(-1.0)) / (phi(2.0) - phi(-2.0))
    assert got[0] == pytest.approx(0.3 * normal) and got[1:] == [1.0, None]


def test_constraint_text(spark):
    form = "constraining_axes array<int>, box_lower array<double>, box_upper array<double>"
    rows = [([0, 2], [0.123, 0.0, 0.5], [0.456, 1.0, 0.75]), ([], [0.0] * 3, [1.0] * 3)]
    got = [r.t for r in spark.createDataFrame(rows, form).select(regions.constraint_text(["p", "q", "r"]).alias("t")).collect()]
    assert got == ["p in [0.12, 0.46], r in [0.50, 0.75]", "no axis constrained"]


def test_arms_are_run_for_every_seed(spark):
    arm = lambda shift: lambda seed: spark.createDataFrame([(1, [0.5], float(seed + shift)), (2, [0.7], float("nan"))], "point_id long, theta array<double>, margin double")
    rows = outcomes.run_arms({"a": arm(0), "b": arm(10)}, [1, 2]).collect()
    assert len(rows) == 8
    assert {(r.arm, r.seed, r.margin) for r in rows if r.point_id == 1} == {("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 11.0), ("b", 2, 12.0)}
    assert all(r.margin is None for r in rows if r.point_id == 2)


def test_steps_are_numbered_in_each_run(spark):
    steps = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 9, "z")], "run_id long, t long, k string")
    assert {r.k: r.step for r in outcomes.order_in_run(steps, ["t"]).collect()} == {"y": 0, "x": 1, "z": 0}


def test_band_and_matrix_of_a_sweep(spark):
    cells = [(1.0, 10.0, 5.0), (1.0, 20.0, 28.0), (2.0, 10.0, 39.0), (2.0, 20.0, 70.0), (3.0, 10.0, None)]
    df = spark.createDataFrame(cells, "angle_max double, speed_max double, fail_pct double")
    inside = sweeps.in_band(df).orderBy("rank").collect()
    assert [(r.angle_max, r.speed_max) for r in inside] == [(1.0, 20.0), (2.0, 10.0)]
    near = sweeps.in_band(df, 80.0, 90.0, 85.0, 2).orderBy("rank").collect()
    assert [r.fail_pct for r in near] == [70.0, 39.0]
    matrix = {r.angle_max: (r["10.0"], r["20.0"]) for r in sweeps.sweep_matrix(df, [10.0, 20.0]).collect()}
    assert matrix == {1.0: (5.0, 28.0), 2.0: (39.0, 70.0), 3.0: (None, None)}


def test_files_of_regions_and_campaigns(spark, tmp_path):
    found = spark.createDataFrame([(1, 4, -0.5, [0.25, 0.5], ["b", "a"]), (2, 1, -0.1, [0.75, 0.5], [])], "region long, n long, worst_margin double, centroid array<double>, owners array<string>")
    campaigns.write_regions(found, ["p", "q"], str(tmp_path / "regions"))
    got = campaigns.read_regions(spark, str(tmp_path / "regions"), ["p", "q"]).collect()
    assert sorted((r.region, r.owner, tuple(r.centroid)) for r in got) == [("1", "a", (0.25, 0.5)), ("1", "b", (0.25, 0.5))]
    points = spark.createDataFrame([("c", "x", 1, 0.5), ("c", "y", 1, float("nan"))], "campaign string, arm string, point_id long, margin double")
    campaigns.write_campaign(points, str(tmp_path / "campaign"))
    got = campaigns.read_campaign(spark, str(tmp_path / "campaign")).collect()
    assert sorted((r.arm, r.seed, r.margin is None) for r in got) == [("x", None, False), ("y", None, True)]


def test_campaigns_must_agree(spark):
    meta = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0)], "name string, budget int, scale double")
    campaigns.check_metadata(meta, ["budget"])
    with pytest.raises(ValueError, match="scale"):
        campaigns.check_metadata(meta, ["budget", "scale"])
