"""Further registered queries: padding, outcomes, traces, designs, accuracy, notes, radii, and reports across owners."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import odd
from ..functions.odd import Axis, Scenario
from ..functions.ranges import exact_quantiles, shared
from ..operators import design, importance, outcomes, ranking, rates, regions, sweeps, telemetry
from ..sources import archives, views
from ..streaming import live
from .queries import GRAPH, LOCAL, METRICS, ODD, ORACLE, SCORED, evaluated, failing, log_densities, members, normal_cdf_sql, query, r6, scored, uniform_box, uniform_sql, wilson_sql

PADDED = f"{views.TELEMETRY}, ru AS (SELECT DISTINCT run_id, run_id % 40 AS run_length FROM st), kept AS (SELECT st.* FROM st JOIN ru USING (run_id) WHERE step < run_length)"


def padded_runs(spark, sf_dir):
    st = views.telemetry(spark, sf_dir)
    return st, st.select("run_id").distinct().withColumn("run_length", F.col("run_id") % 40)


@query("c1_padding", f"WITH {PADDED}, n AS (SELECT run_id, count(*) AS n FROM kept GROUP BY 1) SELECT run_id, greatest(coalesce(n, 0), 1) AS valid_count FROM ru LEFT JOIN n USING (run_id)")
def _(spark, sf_dir):
    return outcomes.valid_counts(*padded_runs(spark, sf_dir))


ENDED = f"""{METRICS}, la AS (SELECT run_id, arg_max(xte, step) AS last_xte FROM st GROUP BY 1), oc AS (SELECT run_id, n_steps, margin, n_steps >= 3 AS valid,
 CASE WHEN abs(last_xte * 2) > 2.5 THEN 'out_of_road' WHEN run_id % 13 = 0 THEN 'crash' WHEN run_id % 11 = 0 THEN 'out_of_road' WHEN run_id % 3 = 0 THEN 'road_finished' WHEN run_id % 5 = 0 THEN 'arrive_dest' ELSE 'max_step' END AS outcome FROM mm JOIN la USING (run_id))"""


def ended(spark, sf_dir):
    st = views.telemetry(spark, sf_dir)
    last = st.groupBy("run_id").agg(F.max_by("xte", "step").alias("last_xte"))
    runs = telemetry.composite_margin(telemetry.run_metrics(st)).join(last, "run_id")
    every = lambda k: F.col("run_id") % k == 0
    return runs.withColumns({"outcome": outcomes.outcome(every(5), every(3), every(11), every(13), F.col("last_xte") * 2), "valid": F.col("n_steps") >= 3})


@query("c7_outcome", f"WITH {ENDED} SELECT run_id, outcome FROM oc")
def _(spark, sf_dir):
    return ended(spark, sf_dir).select("run_id", "outcome")


@query("c8_forced_margin", f"""WITH {ENDED}, f AS (SELECT *, -0.001::DOUBLE - (1.0::DOUBLE - n_steps / 300.0::DOUBLE) AS forced FROM oc)
SELECT run_id, round(CASE WHEN outcome IN ('out_of_road', 'crash') AND valid THEN least(coalesce(margin, forced), forced) ELSE margin END, 6) AS margin FROM f""")
def _(spark, sf_dir):
    m = outcomes.forced_margin(F.col("margin"), F.col("outcome"), F.col("valid"), F.col("n_steps"))
    return ended(spark, sf_dir).select("run_id", r6(m, "margin"))


@query("c13_survival", f"WITH {views.TELEMETRY} SELECT run_id, count(*) FILTER (abs(steering) + abs(floor(abs(xte))) > 0) AS survival FROM st GROUP BY 1")
def _(spark, sf_dir):
    return outcomes.survival(views.telemetry(spark, sf_dir).withColumn("lane", F.floor(F.abs("xte"))), ["steering", "lane"])


@query("c14_worst_trace", f"WITH {METRICS}, w AS (SELECT run_id FROM mm WHERE margin IS NOT NULL ORDER BY margin, run_id LIMIT 1) SELECT run_id, step, round(xte, 6) AS xte, steering FROM st JOIN w USING (run_id)")
def _(spark, sf_dir):
    st = views.telemetry(spark, sf_dir)
    trace = outcomes.worst_trace(st, telemetry.composite_margin(telemetry.run_metrics(st)))
    return trace.select("run_id", F.col("step").cast("long").alias("step"), r6("xte", "xte"), "steering")


@query("c16_state_actions", f"""WITH {views.TELEMETRY}, x AS (SELECT run_id, step, speed_kmh AS velocity, greatest(0.0, 60.0 - step * 1.5)::DOUBLE AS distance, step * 0.1::DOUBLE AS time, CASE WHEN step * 0.1::DOUBLE >= (run_id % 10) * 0.1::DOUBLE AND speed_kmh > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS brake FROM st)
SELECT run_id, count(*) AS n, round(avg(velocity), 6) AS velocity, round(avg(distance), 6) AS distance, round(max(time), 6) AS time, round(avg(brake), 6) AS braking FROM x GROUP BY 1""")
def _(spark, sf_dir):
    st = views.telemetry(spark, sf_dir)
    runs = st.select("run_id").distinct().withColumns({"detection_dist": F.lit(60.0), "delay": (F.col("run_id") % 10) * F.lit(0.1)})
    rows = outcomes.state_actions(st.withColumns({"velocity": F.col("speed_kmh"), "position": F.col("step") * 1.5}), runs, 0.1)
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), r6(F.avg("velocity"), "velocity"), r6(F.avg("distance"), "distance"), r6(F.max("time"), "time"), r6(F.avg("brake"), "braking"))


@query("c17_split", f"""WITH a AS (SELECT o_orderkey AS id, 'orders' AS source FROM orders UNION ALL SELECT c_custkey, 'customers' FROM customer)
SELECT source, CASE WHEN {uniform_sql('id', 77)} < 0.2 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM a GROUP BY 1, 2""")
def _(spark, sf_dir):
    archives = [views.table(spark, sf_dir, t).select(F.col(k).alias("id"), F.lit(n).alias("source")) for t, k, n in (("orders", "o_orderkey", "orders"), ("customer", "c_custkey", "customers"))]
    return outcomes.with_split(archives, "id").groupBy("source", "split").agg(F.count("*").alias("n"))


@query("c15_trajectory_modes")
def _(spark, sf_dir):
    codes, _, _ = outcomes.trajectory_modes(views.telemetry(spark, sf_dir), ["xte", "steering"], 12, 0.9)
    return codes.select("run_id", F.transform("code", lambda x: F.round(x, 6)).alias("code"))


@query("d1_centreline")
def _(spark, sf_dir):
    angle = lambda k: ((F.col("p_partkey") * (31 + k) + k * k) % 121 - 60).cast("double")
    roads = views.table(spark, sf_dir, "part").where("p_partkey is not null").select(F.col("p_partkey").alias("run_id"), F.array(*map(angle, range(5))).alias("angles"), (10 + F.col("p_size") % 30).alias("segment"))
    return outcomes.centreline(roads).select("run_id", "vertex", r6("x", "x"), r6("y", "y"))


@query("e3_rare_summary", f"WITH {SCORED} SELECT arm, point_id, round(t0, 4) AS quantity, round(t1, 4) AS discount, round(t2, 4) AS tax FROM sc WHERE margin < 0 AND is_rare")
def _(spark, sf_dir):
    names = [a.name for a in ODD.axes]
    rows = scored(spark, sf_dir).where("margin < 0 and is_rare").select("arm", "point_id", rates.rare_summary(F.col("theta"), names).alias("m"))
    return rows.select("arm", "point_id", *[F.col("m")[n].alias(n) for n in names])


ACCURACY = f"""{views.EVALUATIONS}, rp AS (SELECT *, CAST(point_id // 10 % 50 AS BIGINT) AS rep FROM ev), pe AS ({wilson_sql('rp', 'rep')})"""


@query("e9_accuracy", f"""WITH {ACCURACY} SELECT count(*) AS reps, round(avg(p), 4) AS mean_p, round(avg(p) - 0.09, 4) AS bias, round(avg(CASE WHEN p_lo <= 0.09 AND p_hi >= 0.09 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS coverage, round(avg(p_hi - p_lo), 4) AS mean_width, round(stddev_pop(p) / 0.09::DOUBLE, 4) AS relative_error FROM pe""")
def _(spark, sf_dir):
    points = views.evaluations(spark, sf_dir).withColumn("rep", F.floor(F.col("point_id") / 10) % 50)
    got = rates.estimator_accuracy(points, "rep", 0.09)
    return got.select("reps", *[F.round(c, 4).alias(c) for c in ("mean_p", "bias")], r6("coverage", "coverage"), *[F.round(c, 4).alias(c) for c in ("mean_width", "relative_error")])


PAIR = " * ".join(f"(1 + 0.5 * abs(x.u{i} - 0.5) + 0.5 * abs(y.u{i} - 0.5) - 0.5 * abs(x.u{i} - y.u{i}))" for i in range(2))
ONE = " * ".join(f"(1 + 0.5 * abs(u{i} - 0.5) - 0.5 * pow(u{i} - 0.5, 2))" for i in range(2))


@query("b10_discrepancy", f"""WITH d AS (SELECT s_nationkey AS design, {uniform_sql('s_suppkey', 1)} AS u0, {uniform_sql('s_suppkey', 2)} AS u1 FROM supplier WHERE s_suppkey IS NOT NULL),
o AS (SELECT design, count(*) AS n, sum({ONE}) AS a FROM d GROUP BY 1), p AS (SELECT x.design, sum({PAIR}) AS b FROM d x JOIN d y ON x.design = y.design GROUP BY 1)
SELECT design, n, round(pow(13 / 12.0::DOUBLE, 2) - 2.0::DOUBLE / n * a + b / (n * n), 6) AS discrepancy FROM o JOIN p USING (design)""")
def _(spark, sf_dir):
    rows = views.table(spark, sf_dir, "supplier").where("s_suppkey is not null")
    u = F.array(*[design.hash_uniform(F.col("s_suppkey"), 1 + j) for j in range(2)])
    got = design.centred_discrepancy(rows.select(F.col("s_nationkey").alias("design"), u.alias("u")), 2, "design")
    return got.select("design", "n", r6("discrepancy", "discrepancy"))


@query("f5_usability", f"WITH {views.RUNS} SELECT arm, bool_and(floor(n_evaluations * 0.1) >= 2) AS all_usable, round(avg(n_evaluations), 6) AS evaluations_mean FROM rs GROUP BY 1")
def _(spark, sf_dir):
    runs = views.run_summary(spark, sf_dir).withColumn("p_fail_usable", importance.usable(F.col("n_evaluations"), 0.1, 2))
    return ranking.arm_statistics(runs).select("arm", "all_usable", r6("evaluations_mean", "evaluations_mean"))


@query("f4_cross_entropy")
def _(spark, sf_dir):
    ids = views.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"))
    t = F.col("theta")
    n = ids.agg(F.max("point_id").alias("n")).first()["n"] or 0
    points, _ = importance.cross_entropy_search(ids, ODD, 0.55 - (t[0] / 100 + t[2]), n + 1, n + 1)
    return importance.weighted_failure(points.withColumn("design", F.lit("mixture")), ["design"])


@query("g1_median_percentile", f"""WITH {SCORED}, a AS (SELECT lf, count(*) AS n FROM rl GROUP BY 1), b AS (SELECT DISTINCT lf FROM sc WHERE margin < 0),
q AS (SELECT lf, (SELECT coalesce(sum(n), 0) FROM a WHERE a.lf < b.lf) * 100.0::DOUBLE / (SELECT count(*) FROM rl) AS pc FROM b)
SELECT arm, round(quantile_cont(pc, 0.5), 6) AS median_percentile FROM sc JOIN q USING (lf) WHERE margin < 0 GROUP BY 1""")
def _(spark, sf_dir):
    points = evaluated(spark, sf_dir)
    got = rates.operational_percentile(points.where("margin < 0"), log_densities(spark, sf_dir), "lf")
    return ranking.failure_percentiles(points, got).select("arm", r6("median_percentile", "median_percentile"))


@query("g20_notes", f"""WITH {views.EVALUATIONS}, s AS (SELECT arm, count(margin) AS n, count(*) FILTER (margin < -0.4) AS f FROM ev GROUP BY 1), t AS (SELECT sum(f) AS f, sum(n) AS n FROM s)
SELECT 'no failures' AS note, CAST(n AS BIGINT) || ' valid points' AS detail FROM t WHERE f = 0 UNION ALL SELECT 'no paired test', '1 seeds, 2 are needed' UNION ALL SELECT 'p_fail not usable', arm FROM s WHERE f < 1""")
def _(spark, sf_dir):
    points = views.evaluations(spark, sf_dir)
    scores = points.groupBy("arm").agg(F.count("margin").alias("n_valid"), F.count_if(F.col("margin") < -0.4).alias("n_failures"))
    return ranking.quality_notes(scores, 1, scores.select("arm", (F.col("n_failures") >= 1).alias("all_usable")))


DISTANCES = f"{views.POINTS}, fp AS (SELECT * FROM pt WHERE margin < 0), nd AS (SELECT x.point_id, sqrt(pow(x.u0 - y.u0, 2) + pow(x.u1 - y.u1, 2) + pow(x.u2 - y.u2, 2) + pow(x.u3 - y.u3, 2)) AS d FROM fp x JOIN fp y ON x.point_id <> y.point_id), kd AS (SELECT point_id, d FROM nd QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d) = 2)"


@query("h2_neighbour_distances", f"WITH {DISTANCES} SELECT point_id, round(d, 6) AS dist FROM kd")
def _(spark, sf_dir):
    return regions.neighbour_distances(failing(spark, sf_dir), 4, 2).select("point_id", r6("dist", "dist"))


@query("h2_eps", f"WITH {DISTANCES} SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS eps FROM kd")
def _(spark, sf_dir):
    d = regions.neighbour_distances(failing(spark, sf_dir), 4, 2)
    eps = exact_quantiles(d, F.col("dist"), {"eps": 0.5}, [])
    return d.agg(F.count("*").alias("n")).join(F.broadcast(eps), F.lit(True)).select("n", r6("eps", "eps"))


@query("h7_box_chances", f"WITH RECURSIVE {LOCAL} SELECT region, n, round(p, 6) AS p_hit, round(CASE WHEN p IS NULL THEN NULL WHEN p <= 0 THEN 'inf'::DOUBLE WHEN p >= 1 THEN 1.0 ELSE ln(0.5) / ln(1 - p) END, 4) AS n50, round(1 - pow(1 - p, 120), 6) AS hit_120 FROM rc")
def _(spark, sf_dir):
    p = F.col("p_hit_uniform")
    r = regions.region_records(members(spark, sf_dir), 4)
    return r.select("region", "n", r6(p, "p_hit"), F.round(regions.draws_for_half(p), 4).alias("n50"), r6(regions.hit_chance(p, 120), "hit_120"))


@query("h10_texts", f"""WITH RECURSIVE {GRAPH} SELECT region, {" || ', ' || ".join(f"printf('p{i}=%.2f', avg(u{i}))" for i in range(4))} AS centroid FROM rg JOIN fp USING (point_id) GROUP BY region""")
def _(spark, sf_dir):
    r = regions.region_records(members(spark, sf_dir), 4)
    return r.select("region", regions.centroid_text(["p0", "p1", "p2", "p3"]).alias("centroid"))


@query("h16_arm_reports", f"""WITH RECURSIVE {GRAPH}, d AS (SELECT owner, count(DISTINCT region) AS n_regions FROM rg JOIN fp USING (point_id) GROUP BY 1)
SELECT owner, count(margin) AS n_evaluations, count(*) FILTER (margin < 0) AS n_failures, round(count(*) FILTER (margin < 0) / count(margin)::DOUBLE, 6) AS failure_rate, round(min(margin), 6) AS worst_margin, coalesce(max(n_regions), 0) AS n_regions FROM pt LEFT JOIN d USING (owner) GROUP BY owner""")
def _(spark, sf_dir):
    got = regions.arm_reports(views.region_points(spark, sf_dir), regions.discoveries(members(spark, sf_dir)))
    return got.select("owner", "n_evaluations", "n_failures", r6("failure_rate", "failure_rate"), r6("worst_margin", "worst_margin"), "n_regions")


@query("i4_backend_regions", f"""WITH {views.BACKENDS}, d AS (SELECT DISTINCT backend AS owner, t0 AS region FROM br WHERE margin < 0 AND t0 IS NOT NULL), s AS (SELECT owner, count(*) AS n FROM d GROUP BY 1),
x AS (SELECT count(*) AS shared FROM d a JOIN d b USING (region) WHERE a.owner = 'fast' AND b.owner = 'full')
SELECT 'fast' AS a, 'full' AS b, shared, f.n - shared AS only_a, g.n - shared AS only_b, round(shared / (f.n + g.n - shared)::DOUBLE, 6) AS jaccard FROM x, (SELECT n FROM s WHERE owner = 'fast') f, (SELECT n FROM s WHERE owner = 'full') g""")
def _(spark, sf_dir):
    runs = views.backend_runs(spark, sf_dir).where("theta[0] is not null")
    return sweeps.backend_regions(runs, [1.0], [50.0], 0.5 / 49).select("a", "b", "shared", "only_a", "only_b", r6("jaccard", "jaccard"))


MIDDLE = ", ".join(f"round({(lo + hi) / 2!r}::DOUBLE, 6)" for lo, hi in zip(ODD.lower, ODD.upper))


@query("b6_nominal", f"SELECT point_id, t0, t1, t2, false AS is_nominal FROM ({ORACLE['b3_to_bounds']}) UNION ALL SELECT -1, {MIDDLE}, true")
def _(spark, sf_dir):
    got = design.with_nominal(uniform_box(spark, sf_dir), ODD)
    return got.select("point_id", *[r6(F.col("theta")[i], f"t{i}") for i in range(3)], "is_nominal")


@query("b8_repaired", f"WITH {views.EVALUATIONS} SELECT arm, point_id, round(least(t1, t2 - 1e-6::DOUBLE), 7) AS low, t2 AS high FROM ev")
def _(spark, sf_dir):
    theta = design.repaired(F.col("theta"), 1, 2)
    return views.evaluations(spark, sf_dir).select("arm", "point_id", F.round(theta[1], 7).alias("low"), theta[2].alias("high"))


@query("b12_execution_plan", f"""WITH {views.EVALUATIONS}, a AS (SELECT arm, row_number() OVER (ORDER BY arm) AS ap FROM (SELECT DISTINCT arm FROM ev)), s AS (SELECT seed, row_number() OVER (ORDER BY seed) AS sp FROM (SELECT DISTINCT seed FROM ev WHERE seed IS NOT NULL))
SELECT arm, seed, row_number() OVER (ORDER BY sp, ap) - 1 AS run_index FROM a, s""")
def _(spark, sf_dir):
    ev = views.evaluations(spark, sf_dir)
    at = lambda c: ev.where(F.col(c).isNotNull()).select(c).distinct().withColumn(f"{c}_pos", F.row_number().over(Window.orderBy(c)))
    return design.execution_plan(at("arm"), at("seed"), "interleaved").select("arm", "seed", F.col("run_index").cast("long").alias("run_index"))


@query("c6_path_per_decision", f"""WITH {views.TELEMETRY}, d AS (SELECT run_id, sqrt(pow(step * 1.5::DOUBLE - lag(step * 1.5::DOUBLE) OVER w, 2) + pow(xte - lag(xte) OVER w, 2)) AS far FROM st WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, round(coalesce(avg(far), 0), 6) AS meters_per_decision FROM d GROUP BY run_id""")
def _(spark, sf_dir):
    st = views.telemetry(spark, sf_dir).withColumns({"x": F.col("step") * 1.5, "y": F.col("xte")})
    return telemetry.path_per_decision(st).select("run_id", r6("meters_per_decision", "meters_per_decision"))


@query("d2_arc_length", f"""WITH {views.ROADS}, b AS (SELECT run_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM ve GROUP BY 1), l AS (SELECT run_id, sum(len) AS length FROM sg GROUP BY 1)
SELECT run_id, round(length, 6) AS length, x_min, x_max, y_min, y_max FROM b JOIN l USING (run_id)""")
def _(spark, sf_dir):
    vertices = views.roads(spark, sf_dir).select("run_id", F.posexplode("xy").alias("vertex", "p")).select("run_id", "vertex", "p.x", "p.y")
    return sweeps.arc_length(vertices).withColumn("length", F.round("length", 6))


FIRST_SEEDS = f"""{views.EVALUATIONS}, ra AS (SELECT arm, row_number() OVER (ORDER BY count(*) FILTER (margin < 0) / count(margin)::DOUBLE DESC, arm) AS rank_a FROM ev GROUP BY arm),
rb AS (SELECT arm, row_number() OVER (ORDER BY count(*) FILTER (margin < 0) / count(margin)::DOUBLE DESC, arm) AS rank_b FROM ev WHERE seed < 6 GROUP BY arm)"""


@query("g9_leaderboards", f"WITH {FIRST_SEEDS} SELECT arm, rank_a, rank_b FROM ra FULL JOIN rb USING (arm)")
def _(spark, sf_dir):
    ev = views.evaluations(spark, sf_dir)
    board = lambda points: ranking.leaderboard(rates.failure_rate(points, ["arm"]), "p")
    both = ranking.compare_leaderboards(board(ev), board(ev.where("seed < 6")), ODD.lower + ODD.upper, ODD.lower + ODD.upper)
    return both.select("arm", *[F.col(c).cast("long").alias(c) for c in ("rank_a", "rank_b")])


@query("k1_running_margin", f"WITH {METRICS} SELECT run_id, n_steps, round(margin, 6) AS margin FROM mm")
def _(spark, sf_dir):
    return live.running_margin(views.telemetry(spark, sf_dir)).select("run_id", "n_steps", r6("margin", "margin"))


@query("k4_once_per_job", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf_dir):
    jobs = views.table(spark, sf_dir, "events").withColumn("job_id", F.struct("user_id", "event_type"))
    return live.once_per_job(jobs, "ts").select("user_id", "event_type")


@query("k6_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL '12 hours', true)::INT AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no""")
def _(spark, sf_dir):
    got = live.sessions(views.table(spark, sf_dir, "events"), "ts", "user_id", "12 hours")
    return got.select("user_id", F.col("session.start").alias("start"), "n")


@query("a2_saved_campaigns", f"""WITH {views.EVALUATIONS} SELECT arm, CASE WHEN arm LIKE 'plain%' THEN NULL ELSE seed END AS seed, count(*) AS n_points, count(margin) AS n_valid, round(min(margin), 6) AS worst_margin, round(sum(t0 + 100 * t1 + 1000 * t2), 4) AS total FROM ev GROUP BY 1, 2""")
def _(spark, sf_dir):
    """All evaluations through saved archives and back; one family is saved without seeds, as old campaigns were."""
    points = views.evaluations(spark, sf_dir).withColumn("seed", F.when(~F.col("arm").startswith("plain"), F.col("seed")))
    path = f"{shared(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_archives(points, path, [a.name for a in ODD.axes])
    t = F.col("theta")
    got = archives.read_archives(spark, path).groupBy("arm", "seed").agg(F.count("*").alias("n_points"), F.count("margin").alias("n_valid"), F.round(F.min("margin"), 6).alias("worst_margin"), F.round(F.sum(t[0] + 100 * t[1] + 1000 * t[2]), 4).alias("total"))
    return got.withColumn("seed", F.col("seed").cast("int"))


DRAW = uniform_sql("(point_id % 2147483647 * 4096 + rep)", 3)
INVERTED = " ".join(f"WHEN u < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(importance.POISSON))


@query("f3_bootstrap", f"""WITH {views.EVALUATIONS}, w AS (SELECT rep, x, CASE {INVERTED} ELSE 11 END AS k FROM (SELECT rep, CASE WHEN margin < 0 THEN 1.0::DOUBLE ELSE 0.0 END AS x, {DRAW} AS u FROM ev, range(200) r(rep) WHERE margin IS NOT NULL)),
m AS (SELECT rep, sum(k * x) / sum(k) AS m FROM w GROUP BY rep) SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def _(spark, sf_dir):
    """Interval of the failure rate of all valid evaluations over 200 resamples."""
    points = views.evaluations(spark, sf_dir).where("margin is not null").select("point_id", (F.col("margin") < 0).cast("double").alias("x"))
    got = importance.poisson_bootstrap(points, "x", resamples=200, seed=3)
    return got.select(r6("lo", "lo"), r6("hi", "hi"))


#: Operational marginals over the cube of the region points: two truncated normals, two uniforms.
CUBE = Scenario((Axis("a", 0.0, 1.0, "truncnorm", 0.5, 0.2), Axis("b", 0.0, 1.0, "truncnorm", 0.3, 0.25), Axis("c", 0.0, 1.0), Axis("d", 0.0, 1.0)))


def span_sql(axis: Axis, i: int) -> str:
    if axis.family == "uniform":
        return f"(h{i} - l{i})"
    z = lambda end: f"(({end}{i} - {axis.mu!r}::DOUBLE) / {axis.sigma!r}::DOUBLE)"
    mass = odd._phi((axis.upper - axis.mu) / axis.sigma) - odd._phi((axis.lower - axis.mu) / axis.sigma)
    return f"((({normal_cdf_sql(z('h'))}) - ({normal_cdf_sql(z('l'))})) / {mass!r}::DOUBLE)"


BOXES = f"""{GRAPH}, bx AS (SELECT region, count(*) AS n, {', '.join(f'greatest(0.0::DOUBLE, min(u{i}) - 0.02) AS l{i}, least(1.0::DOUBLE, max(u{i}) + 0.02) AS h{i}' for i in range(4))} FROM rg JOIN fp USING (point_id) GROUP BY region),
cb AS (SELECT *, {', '.join(f'n >= 4 AND h{i} - l{i} < 0.5 * (n - 1) / (n + 1) AS c{i}' for i in range(4))} FROM bx)"""
BOX_TEXT = ", ".join(f"CASE WHEN c{i} THEN printf('{a.name} in [%.2f, %.2f]', l{i}, h{i}) END" for i, a in enumerate(CUBE.axes))


@query("h7_operational_chance", f"""WITH RECURSIVE {BOXES} SELECT region, n, round(CASE WHEN n >= 4 THEN {' * '.join(f'CASE WHEN c{i} THEN {span_sql(a, i)} ELSE 1.0::DOUBLE END' for i, a in enumerate(CUBE.axes))} END, 6) AS p_hit,
 CASE WHEN c0 OR c1 OR c2 OR c3 THEN concat_ws(', ', {BOX_TEXT}) ELSE 'no axis constrained' END AS constraints FROM cb""")
def _(spark, sf_dir):
    """Each region's chance under the operational marginals, and the conditions that define it."""
    r = regions.region_records(members(spark, sf_dir), 4)
    return r.select("region", "n", r6(regions.hit_under(CUBE), "p_hit"), regions.constraint_text([a.name for a in CUBE.axes]).alias("constraints"))
