"""Outcomes, traces, roads, control replay, modes, merges and plans against direct computation."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflow.functions.odd import Axis, Scenario, angle_axis, axis_ppf, quick_ppf, speed_axis
from rareflow.functions.ranges import average_ranks, exact_quantiles, prefix_sums
from rareflow.operators import importance, outcomes, ranking, regions
from rareflow.operators.control import ControlLaw, Memory
from rareflow.sources import campaigns


def test_outcome_cascade_last_match_wins(spark):
    rows = [(True, False, False, False, 0.0), (True, True, False, False, 0.0), (True, True, True, False, 0.0), (True, True, True, True, 0.0), (True, True, False, True, -2.6), (None, None, None, None, None)]
    got = spark.createDataFrame(rows, "a boolean, f boolean, o boolean, c boolean, x double").select(outcomes.outcome(*map(F.col, "afocx"))).collect()
    assert [r[0] for r in got] == ["arrive_dest", "road_finished", "out_of_road", "crash", "out_of_road", "max_step"]


def test_forced_margin(spark):
    rows = [(0.5, "crash", True, 30), (-3.0, "crash", True, 30), (None, "out_of_road", True, 300), (0.5, "crash", False, 30), (0.5, "max_step", True, 30)]
    got = spark.createDataFrame(rows, "m double, o string, v boolean, s int").select(outcomes.forced_margin(*map(F.col, "movs"))).collect()
    assert [r[0] for r in got] == [pytest.approx(-0.901), -3.0, pytest.approx(-0.001), 0.5, 0.5]


def test_quantiles_ranks_and_prefix_sums(spark):
    r = random.Random(2)
    rows = [(g, r.choice([r.random(), 0.5, float(r.randint(0, 3))])) for g in "ab" for _ in range(777)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: x for x in exact_quantiles(df, F.col("v"), {"lo": 0.05, "mid": 0.5, "top": 1.0}, ["g"]).collect()}
    assert set(got) == set("abc")
    for g in "abc":
        v = [x for k, x in rows if k == g]
        assert [got[g][k] for k in ("lo", "mid", "top")] == pytest.approx([np.quantile(v, q) for q in (0.05, 0.5, 1.0)])
    keys = spark.createDataFrame([(k, k % 3) for k in range(500)], "k long, n long").repartition(4)
    assert all(x.before == sum(j % 3 for j in range(x.k)) for x in prefix_sums(keys, "k", "n").collect())
    ranks = {x.v: x.r for x in average_ranks(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double"), "v", "r").collect()}
    assert ranks == {1.0: 1, 2.0: 2.5, 5.0: 4}


def test_student_p():
    # t with 8 degrees: rho 0.6319 is the published two-sided 5 % point for n = 10, 0.7646 the 1 % point
    assert ranking.student_p(0.6319, 10) == pytest.approx(0.05, abs=1e-4) and ranking.student_p(0.7646, 10) == pytest.approx(0.01, abs=1e-4)
    assert ranking.student_p(0.0, 10) == pytest.approx(1.0) and ranking.student_p(1.0, 5) == 0.0


def arc(p, n):
    t = [0.0]
    for a, b in zip(p, p[1:]):
        t.append(t[-1] + math.dist(a, b) ** 0.5)
    out = []
    for k in range(n):
        x = t[1] + (t[2] - t[1]) * k / (n - 1)
        level = [np.array(q) for q in p]
        for depth in (1, 2):
            level = [((t[i + depth] - x) * level[i] + (x - t[i]) * level[i + 1]) / (t[i + depth] - t[i]) for i in range(len(level) - 1)]
        out.append(((t[2] - x) * level[0] + (x - t[1]) * level[1]) / (t[2] - t[1]))
    return out


def test_centreline(spark):
    angles = [10.0, -30.0, 45.0, 0.0, 80.0]
    nodes, turn = [(25.0, 0.0), (0.0, 0.0)], 0.0
    for a in angles:
        turn += a
        nodes.append((nodes[-1][0] + 25 * math.cos(math.radians(turn)), nodes[-1][1] + 25 * math.sin(math.radians(turn))))
    want = [v for j in range(4) for v in arc(nodes[j : j + 4], 20)[1 if j else 0 :]]
    got = outcomes.centreline(spark.createDataFrame([(1, angles, 25)], "run_id long, angles array<double>, segment int")).orderBy("vertex").collect()
    assert len(got) == 77 and [r.vertex for r in got] == list(range(77))
    assert np.allclose([(r.x, r.y) for r in got], want)


def test_centrelines_are_dealt_by_number(spark):
    few = spark.range(2 * outcomes.ROADS + 1).coalesce(1).select(F.col("id").alias("run_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("angles"), F.lit(10).alias("segment"))
    got = outcomes.centreline(few, points=2)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 2 * few.count()
    assert outcomes.centreline(few.where("run_id < 0")).count() == 0


def test_control_replay(spark):
    r = random.Random(4)
    rows = [(run, k, r.uniform(-3, 3), r.uniform(-1, 1), r.uniform(0, 12), 8.0, r.choice([0.1, 0.05, -1.0])) for run in (1, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "run_id long, step int, lateral double, heading double, speed double, target double, dt double").repartition(3)
    for latency, tau, rate in ((0, 0.0, 0.0), (0, 0.0, 4.0), (2, 0.3, 4.0)):
        got = {(x.run_id, x.step): x for x in outcomes.replay_control(df, latency, tau, max_rate=rate).collect()}
        for run in (1, 2):
            mine, last, held = [x for x in rows if x[0] == run], 0.0, None
            for k, x in enumerate(mine):
                dt = x[6] if x[6] > 0 else 0.05
                old = mine[max(0, k - latency)]
                keep = math.exp(-dt / tau) if tau else 0.0
                held = (old[2], old[3]) if held is None else tuple(keep * h + (1 - keep) * e for h, e in zip(held, (old[2], old[3])))
                wish = min(1, max(-1, -0.35 * held[0] - 0.8 * held[1]))
                last = last + min(rate * dt, max(-rate * dt, wish - last)) if rate else wish
                assert got[run, k].steer == pytest.approx(last) and got[run, k].throttle == pytest.approx(min(1, max(-1, 0.3 * (8 - x[4]))))


def test_many_runs_are_replayed_in_few_groups(spark):
    r = random.Random(5)
    rows = [(run, k, r.uniform(-3, 3), r.uniform(-1, 1), 5.0, 8.0, r.choice([0.1, 0.0])) for run in (*range(3000), None) for k in range(1 + (run or 0) % 4 + 20 * (run == 7))]
    df = spark.createDataFrame(rows, "run_id long, step int, lateral double, heading double, speed double, target double, dt double").repartition(3)
    for latency, tau, rate in ((0, 0.0, 0.0), (2, 0.3, 4.0)):
        got = outcomes.replay_control(df, latency, tau, max_rate=rate)
        assert "share" in got._jdf.queryExecution().optimizedPlan().toString()
        law, want, memory = ControlLaw(latency, tau, max_rate=rate), {}, {}
        for run, k, lateral, heading, *_, dt in rows:
            want[run, k] = law.steer(memory.setdefault(run, Memory.fresh()), lateral, heading, dt)
        have = {(x.run_id, x.step): x.steer for x in got.collect()}
        assert have.keys() == want.keys() and all(have[x] == pytest.approx(want[x], abs=1e-12) for x in want)
    runs = [10] * 40 + [1, 300]
    x = np.random.default_rng(1).normal(size=(3, sum(runs)))
    side, each = law.replay(np.array(runs), *x)[0], [law.replay(np.array([n]), *x[:, sum(runs[:i]) : sum(runs[: i + 1])])[0] for i, n in enumerate(runs)]
    assert side.tolist() == np.concatenate(each).tolist()


def test_trajectory_modes(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 3)) @ r.normal(size=(3, 8))
    rows = [(i, t, float(x[i, t]), float(x[i, 4 + t])) for i in range(60) for t in range(4)]
    steps = spark.createDataFrame(rows, "run_id long, step int, a double, b double").repartition(3)
    codes, modes, explained = outcomes.trajectory_modes(steps, ["a", "b"], 4, 0.999)
    c = x - x.mean(axis=0)
    values = np.linalg.svd(c, compute_uv=False) ** 2
    assert len(modes) == 3 and np.allclose(explained, (values / values.sum())[:3])
    z = np.array([row.code for row in codes.orderBy("run_id").collect()])
    assert np.allclose(z @ modes, c)


def test_merge_refuses_differing_copies(spark):
    form = "arm string, seed int, margin double"
    one = spark.createDataFrame([("x", 1, -1.0), ("x", 1, 2.0), ("y", 1, 0.5)], form)
    same = spark.createDataFrame([("x", 1, 2.0), ("x", 1, -1.0), ("z", 2, 0.1)], form)
    assert sorted(r.arm for r in campaigns.merge_campaigns(one, same).collect()) == ["x", "x", "y", "z"]
    assert sorted(r.arm for r in campaigns.merge_campaigns(one, same, ["z"]).collect()) == ["x", "x", "y", "z"]
    with pytest.raises(ValueError, match="arm x"):
        campaigns.merge_campaigns(one, spark.createDataFrame([("x", 1, 5.0)], form))
    with pytest.raises(ValueError, match="cannot be verified"):
        campaigns.merge_campaigns(one, spark.createDataFrame([("x", None, -1.0)], form))


def test_plans_need_their_keys(spark, tmp_path):
    good = {"alpha": 0.05, "metric": "rare", "hypotheses": [{"id": "H1", "a": "x", "b": "y", "direction": "a>b", "rationale": "r"}]}
    for k, (plan, fine) in enumerate([(good, True), ({"alpha": 0.05}, False), ({**good, "hypotheses": []}, False), ({**good, "metric": None}, False), ({**good, "hypotheses": [{"id": "H1", "a": "x", "b": "y", "direction": "maybe"}]}, False)]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(plan))
        if fine:
            assert [r.id for r in campaigns.read_plan(spark, str(path)).collect()] == ["H1"]
        else:
            with pytest.raises(ValueError):
                campaigns.read_plan(spark, str(path))


def test_backend_runs_and_tables_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("a", 0.5, 0, [1.0], 0.25, True, 9.0, 0.5), ("a", 0.5, 1, [2.0], None, False, 9.0, 0.5)], "backend string, speed_scale double, scenario_idx int, theta array<double>, margin double, valid boolean, control_hz double, meters_per_step double")
    campaigns.write_backend_runs(runs, str(tmp_path / "runs"))
    got = campaigns.read_backend_runs(spark, str(tmp_path / "runs")).select(*runs.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, runs.collect()))
    campaigns.write_table(runs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("theta = '[1.0]'").count() == 1


def test_cross_entropy_finds_a_tail(spark):
    tail = Scenario((Axis("p", 0.0, 1.0), Axis("q", 0.0, 1.0)))
    ids = spark.range(6000).withColumnRenamed("id", "point_id")
    points, history = importance.cross_entropy_search(ids, tail, 0.97 - F.col("theta")[0], 2000, 6000, rho=0.2)
    got = importance.weighted_failure(points.withColumn("g", F.lit(1)), ["g"]).first()
    assert got.p == pytest.approx(0.03, rel=0.15) and history[-1]["gamma"] <= 0 and got.ess > 0


def test_quick_draws_are_the_same(spark):
    axes = [Axis("p", 0.0, 1.0), angle_axis("q", 1.0, 50.0), speed_axis("r", 0.0, 0.1), Axis("s", -9.0, 9.0, "truncnorm", 0.0, 0.5)]
    u = [0.0, 1e-12, 1e-7, 0.02, 0.024, 0.3, 0.5, 0.7, 0.976, 0.99, 1 - 1e-9, 1.0, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(u)], "point_id long, u double")
    got = rows.select("*", *[axis_ppf(a, F.col("u"), quick_ppf()).alias(f"t{j}") for j, a in enumerate(axes)]).orderBy("point_id").collect()
    want = rows.select("*", *[axis_ppf(a, F.col("u")).alias(f"t{j}") for j, a in enumerate(axes)]).orderBy("point_id").collect()
    for x, y in zip(got, want, strict=True):
        assert x.u is None and x == y or tuple(x)[2:] == pytest.approx(tuple(y)[2:], rel=1e-12, abs=1e-12)
    points, _ = importance.cross_entropy_search(rows, Scenario(tuple(axes)), F.col("theta")[0] - 2.0, 13, 13)
    assert "lambda" not in points._jdf.queryExecution().optimizedPlan().toString()


def test_eps_grows_with_lonely_points(spark):
    r = random.Random(6)
    cloud = [(i, [r.random() for _ in range(3)]) for i in range(80)] + [(100, [0.0, 0.0, 0.0]), (101, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(cloud, "point_id long, u array<double>").repartition(3)
    got = {x.point_id: x.dist for x in regions.neighbour_distances(df, 3, 2).collect()}
    for i, u in cloud:
        assert got[i] == pytest.approx(sorted(math.dist(u, v) for j, v in cloud if j != i)[1])
    assert regions.estimated_eps(df, 3, 2) == pytest.approx(np.median(list(got.values())))
    assert regions.estimated_eps(df.limit(2), 3, 2) == math.sqrt(3) / 4


def test_merge_sorts_no_arm(spark):
    form = "arm string, seed int, margin double"
    one, two = (spark.createDataFrame([("x", 1, -1.0), (arm, 1, 2.0)], form) for arm in "yz")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = campaigns.merge_campaigns(one, two)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [arm" in plan and "LeftAnti" in plan.split("BroadcastHashJoin", 1)[1].split("\n")[0]
