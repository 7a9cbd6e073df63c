"""Distribution functions, tests on ranks, regions, telemetry and streams against closed forms and brute force."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflow.functions import odd
from rareflow.operators import design, importance, ranking, rates, regions, sweeps, telemetry
from rareflow.sources import campaigns
from rareflow.streaming import live

NORMAL = statistics.NormalDist()


def test_normal_functions(spark):
    rows = spark.range(1, 1000).select(((F.col("id") - 500) / 65.0).alias("z"), (F.col("id") / 1000.0).alias("p"))
    for r in rows.select("z", "p", odd.normal_cdf(F.col("z")).alias("c"), odd.normal_ppf(F.col("p")).alias("q")).collect():
        assert abs(r.c - NORMAL.cdf(r.z)) < 1e-13
        assert abs(r.q - NORMAL.inv_cdf(r.p)) < 1e-9


def test_log_density_and_dimension(spark):
    s = odd.Scenario((odd.Axis("a", 0, 1, "truncnorm", 0, 2), odd.Axis("b", 0, 10)))
    rows = spark.createDataFrame([([0.5, 3.0],), ([2.0, 3.0],)], "theta array<double>")
    got = [r[0] for r in rows.select(odd.log_density(s, F.col("theta"))).collect()]
    mass = NORMAL.cdf(0.5) - 0.5
    assert got[0] == pytest.approx(math.log(NORMAL.pdf(0.25) / 2 / mass) - math.log(10))
    assert got[1] == -math.inf
    with pytest.raises(Exception):
        spark.createDataFrame([([0.5],)], "theta array<double>").select(odd.log_density(s, F.col("theta"))).collect()


def test_latin_hypercube_has_one_point_in_each_stratum(spark):
    ids = spark.range(40).select(F.col("id").alias("point_id"), F.lit(1).alias("d"))
    for row in np.array([r.u for r in design.latin_hypercube(ids, 3, "d").collect()]).T:
        assert sorted((row * 40).astype(int)) == list(range(40))


def test_signed_rank_against_enumeration(spark):
    rows, want = [], {}
    for seed in range(6):
        d = np.array(random.Random(seed).sample(range(-40, 41), 8 if seed else 3), float)
        d = d[np.unique(np.abs(d), return_index=True)[1]]
        rows += [(seed, x, 0.0) for x in d.tolist()] + [(seed, 2.0, 2.0), (seed, float("nan"), 1.0), (seed, None, 1.0)]
        d = d[d != 0]
        ranks = np.argsort(np.argsort(np.abs(d))) + 1
        w, middle = ranks[d > 0].sum(), ranks.sum() / 2
        every = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        want[seed] = (w, min(1, np.mean([abs(x - middle) >= abs(w - middle) for x in every])))
    got = {r.k: r for r in ranking.paired_tests(spark.createDataFrame(rows, "k int, a double, b double"), ["k"]).collect()}
    for seed, (w, p) in want.items():
        assert got[seed].w_plus == w and got[seed].p == pytest.approx(p)


def test_signed_rank_with_ties_many_and_none(spark):
    tied = [(0, x, 0.0) for x in (1.0, -1.0, 2.0, 2.0, 3.0)]
    many = [(1, float(k) * (-1) ** (k % 3 == 0), 0.0) for k in range(1, 61)]
    rows = tied + many + [(2, 1.0, 1.0), (2, 3.0, 3.0), (3, 1.0, 0.0), (4, None, 0.0)]
    got = {r.k: r for r in ranking.paired_tests(spark.createDataFrame(rows, "k int, a double, b double"), ["k"]).collect()}
    sd = math.sqrt(5 * 6 * 11 / 24 - 2 * 6 / 48)
    assert got[0].w_plus == 13.5 and got[0].p == pytest.approx(math.erfc(abs(13.5 - 7.5) / sd / math.sqrt(2)))
    w = sum(k for k in range(1, 61) if k % 3)
    assert got[1].w_plus == w and got[1].p == pytest.approx(math.erfc(abs(w - 915) / math.sqrt(60 * 61 * 121 / 24) / math.sqrt(2)))
    assert [(got[k].n, got[k].w_plus, got[k].p) for k in (2, 3, 4)] == [(2, None, None), (1, None, None), (0, None, None)]


def test_clean_sweep_and_stop_rule(spark):
    rows = [(a, s, v + s / 100) for a, v in (("x", 5.0), ("y", 3.0), ("z", 3.0)) for s in range(12)]
    seeds = spark.createDataFrame(rows, "arm string, seed int, score double")
    plan = spark.createDataFrame([(0, "H1", "x", "y", "a>b"), (1, "H2", "y", "z", "a>b"), (2, "H3", "x", "z", "a>b")], "pos int, id string, a string, b string, direction string")
    status = {r.id: r.status for r in ranking.fixed_sequence(plan, seeds).collect()}
    assert status == {"H1": "rejected", "H2": "not rejected", "H3": "not tested"}


def test_holm_runs_up(spark):
    t = spark.createDataFrame([("c", "a", "b", 0.01), ("c", "a", "d", 0.04), ("c", "b", "d", 0.03), ("c", "x", "y", None)], "campaign string, arm_a string, arm_b string, p double")
    got = {(r.arm_a, r.arm_b): r.p_holm for r in ranking.holm(t, ["campaign"]).collect()}
    assert got == {("a", "b"): pytest.approx(0.03), ("b", "d"): pytest.approx(0.06), ("a", "d"): pytest.approx(0.06), ("x", "y"): None}


def test_regions_against_brute_force(spark):
    r = random.Random(3)
    pts = [(i, [r.random() for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(pts, "point_id long, u array<double>")
    eps = 0.2
    near = {(a, b) for (a, x), (b, y) in itertools.combinations(pts, 2) if math.dist(x, y) <= eps}
    assert {(p.a, p.b) for p in regions.eps_pairs(df, eps).collect()} == near
    label = {i: i for i, _ in pts}
    for _ in pts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert {p.point_id: p.region for p in regions.dbscan(df, eps).collect()} == label


def test_closed_form_margin(spark):
    rows = [(1, i, 0.5, 0.1) for i in range(5)] + [(2, i, x, s) for i, (x, s) in enumerate(zip((0.0, 1.0, 2.0, 3.0, 3.0), (0.0, 0.2, 0.5, 0.8, 0.8)))] + [(3, 0, 0.0, 0.0), (3, 1, 0.0, 0.0)]
    steps = spark.createDataFrame(rows, "run_id long, step int, xte double, steering double")
    got = {r.run_id: r.margin for r in telemetry.composite_margin(telemetry.run_metrics(steps)).collect()}
    assert got[1] == pytest.approx(1.2) and got[2] < 0 and got[3] is None


def test_wilson_and_empty(spark):
    pts = spark.createDataFrame([("a", -1.0), ("a", 1.0), ("b", None)], "arm string, margin double")
    got = {r.arm: r for r in rates.failure_rate(pts, ["arm"]).collect()}
    assert got["a"].p == 0.5 and got["a"].p_lo < 0.5 < got["a"].p_hi
    assert got["b"].p is None and got["b"].n_invalid == 1
    assert rates.failure_rate(pts.limit(0), ["arm"]).count() == 0


def test_bootstrap_and_calibration(spark):
    rows = spark.range(400).select(F.col("id").alias("point_id"), (F.col("id") % 10 == 0).cast("double").alias("x"))
    r = importance.poisson_bootstrap(rows, "x", resamples=500).first()
    assert r.lo < 0.1 < r.hi and abs(r.hi - r.lo - 2 * 1.96 * (0.09 / 400) ** 0.5) < 0.01
    assert importance.poisson_bootstrap(rows.repartition(7), "x", resamples=500).first() == r  # rows may be dealt anyhow
    weights = np.array([importance.resample_weights(np.arange(3000), rep, 1) for rep in range(50)])
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02
    assert sweeps.calibrate(lambda x: x, 0.0, 1.0)["outcome"] == "centred"
    assert sweeps.calibrate(lambda x: 0.01, 0.0, 1.0)["outcome"] == "too easy"


def test_plan_is_validated(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"alpha": 0.05, "metric": "m", "hypotheses": [{"id": "H1", "a": "x", "b": "y", "direction": "maybe"}]}')
    with pytest.raises(ValueError):
        campaigns.read_plan(spark, str(tmp_path / "p.json"))


def test_replies_to_steps(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"run_id": 1, "positions": [[1, 2, 0], [3, 4, 0]], "xtes": [0.1, 0.2], "steerings": [0, 1], "speeds": [5, 6], "throttles": [1, 1]}\n{"run_id": 2}\n')
    got = campaigns.read_replies(spark, str(tmp_path / "r.json")).orderBy("run_id", "step").collect()
    assert [(r.run_id, r.step, r.y) for r in got] == [(1, 0, 2.0), (1, 1, 4.0), (2, None, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i // 3, (i % 7) / 3, (i % 5) / 5) for i in range(60)], "run_id long, step int, xte double, steering double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.running_margin(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    batch = {r.run_id: r.margin for r in live.running_margin(rows).collect()}
    assert {r.run_id: r.margin for r in spark.table("live").collect()} == pytest.approx(batch)


def test_drift_over_all_arms(spark):
    form = "arm string, run_index int, n_failures long"
    mixed = [("ab"[k % 2], k, 20 - k) for k in range(12)]
    r = ranking.drift(spark.createDataFrame(mixed, form)).first()
    assert (r.n_runs, r.rho, r.interleaved, r.computable, r.drift_detected) == (12, pytest.approx(-1), True, True, True)
    blocks = [("ab"[k // 6], k, (k * 7) % 5) for k in range(12)]
    r = ranking.drift(spark.createDataFrame(blocks, form)).first()
    assert not r.interleaved and r.computable and not r.drift_detected
    r = ranking.drift(spark.createDataFrame([(a, k, 3) for a, k, _ in mixed], form)).first()
    assert (r.rho, r.computable, r.drift_detected) == (None, False, False)
    assert ranking.drift(spark.createDataFrame(mixed[:4], form)).count() == 0


def test_same_margins_without_a_task_for_each_seed(spark):
    """Places that differ, as sorting each arm and seed finds them; but no window sorts a whole arm and seed."""
    r = random.Random(5)
    values = [None, float("nan"), float("inf"), -0.0, 0.0, 0.5, 0.5 + 4e-10, 0.5 + 9e-10, 0.5 + 3e-9, 1e15, 1e15 + 1]
    rows = lambda n: [(r.choice("ab"), r.choice([0, 1, None]), r.choice(values) if r.random() < 0.6 else r.uniform(-1, 1)) for _ in range(n)]
    common = rows(60)
    left, right = common + rows(9), [(a, s, m + 5e-10 if m is not None and r.random() < 0.5 else m) for a, s, m in common] + rows(6) + [("c", 1, 0.5)]
    order = lambda m: (m is not None, math.inf if m is not None and math.isnan(m) else 0 if m is None else m, m is not None and math.isnan(m))
    near = lambda x, y: x is None and y is None or x is not None and y is not None and abs(x - y) <= 1e-9
    want = {}
    for key in {(a, s) for a, s, _ in left + right}:
        x, y = (sorted((m for a, s, m in side if (a, s) == key), key=order) for side in (left, right))
        bad = len(x) + len(y) if key[1] is None else max(len(x), len(y)) - sum(near(p, q) for p, q in zip(x, y))
        want[key[0]] = want.get(key[0], 0) + bad
    form = "arm string, seed int, margin double"
    got = ranking.same_margins(spark.createDataFrame(left, form), spark.createDataFrame(right, form))
    assert {x.arm: x.n_breaches for x in got.collect()} == want
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
