"""Registered queries, one or more for each inventory row, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import odd
from ..functions.ranges import exact_quantiles, ready, stored
from ..operators import design, importance, ranking, rates, regions, roads, surrogate, sweeps, telemetry
from ..sources import campaigns, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ODD = views.SCENARIO


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6).alias(name)


def uniform_sql(ident: str, salt: int) -> str:
    v1 = f"(({ident} * 48271 + {salt} * 69621 + 12345) % 2147483647)"
    v2 = f"(({v1} * {v1} + {ident}) % 2147483647)"
    return f"((({v2} * {v2} + {salt} * 7919 + 1) % 2147483647) / 2147483647::DOUBLE)"


def log_density_sql(columns: list[str]) -> str:
    total, inside = [], []
    for axis, x in zip(ODD.axes, columns, strict=True):
        a = axis.bounded()
        inside.append(f"{x} >= {a.lower!r} AND {x} <= {a.upper!r}")
        if a.family == "uniform":
            total.append(f"- {math.log(a.upper - a.lower)!r}::DOUBLE")
        else:
            mass = odd._phi((a.upper - a.mu) / a.sigma) - odd._phi((a.lower - a.mu) / a.sigma)
            total.append(f"- pow(({x} - {a.mu!r}::DOUBLE) / {a.sigma!r}::DOUBLE, 2) / 2 - ({math.log(a.sigma * math.sqrt(2 * math.pi) * mass)!r}::DOUBLE)")
    return f"CASE WHEN {' AND '.join(inside)} THEN 0 {' '.join(total)} ELSE '-Infinity'::DOUBLE END"


def _poly_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = "0e0"
    for c in coefficients:
        out = f"({out} * {x} + ({c!r}e0))" if "e" not in repr(c) else f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def through_odd_sql(source: str, name: str) -> str:
    """CTEs that bring u0, u1, ... of ``source`` (id) through the marginals' inverse CDFs: ``name`` (id, t0, t1, ...)."""
    p, start, cdf, last = [], [], [], []
    for i, axis in enumerate(ODD.axes):
        a = axis.bounded()
        u = f"least(1 - 1e-12, greatest(1e-12, u{i}))"
        if a.family == "uniform":
            p.append(f"{u} AS p{i}"), start.append(f"p{i} AS x{i}"), cdf.append(f"x{i}, 0e0 AS c{i}, p{i}")
            last.append(f"{a.lower!r}::DOUBLE + x{i} * {a.upper - a.lower!r}::DOUBLE AS t{i}")
            continue
        lo, hi = odd._phi((a.lower - a.mu) / a.sigma), odd._phi((a.upper - a.mu) / a.sigma)
        p.append(f"{lo!r}::DOUBLE + {u} * {hi - lo!r}::DOUBLE AS p{i}")
        q, low = f"(p{i} - 0.5e0)", f"sqrt(-2 * ln(least(p{i}, 1 - p{i})))"
        edge = f"({_poly_sql(odd.EDGE_TOP, low)} / {_poly_sql(odd.EDGE_LOW, low)})"
        start.append(f"p{i}, CASE WHEN abs({q}) <= 0.47575e0 THEN {_poly_sql(odd.MIDDLE_TOP, f'({q} * {q})')} / {_poly_sql(odd.MIDDLE_LOW, f'({q} * {q})')} * {q} WHEN {q} < 0 THEN {edge} ELSE -{edge} END AS x{i}")
        tail = f"(exp(-abs(x{i}) * abs(x{i}) / 2) * {_poly_sql(odd.CDF_TOP, f'abs(x{i})')} / {_poly_sql(odd.CDF_LOW, f'abs(x{i})')})"
        cdf.append(f"p{i}, x{i}, CASE WHEN x{i} > 0 THEN 1 - {tail} ELSE {tail} END AS c{i}")
        h = f"((c{i} - p{i}) * {math.sqrt(2 * math.pi)!r}::DOUBLE * exp(x{i} * x{i} / 2))"
        last.append(f"least({a.upper!r}::DOUBLE, greatest({a.lower!r}::DOUBLE, {a.mu!r}::DOUBLE + {a.sigma!r}::DOUBLE * (x{i} - {h} / (1 + x{i} * {h} / 2)))) AS t{i}")
    return f"""{name}_p AS (SELECT id, {', '.join(p)} FROM {source}), {name}_x AS (SELECT id, {', '.join(start)} FROM (SELECT * FROM {name}_p)), {name}_c AS (SELECT id, {', '.join(cdf)} FROM (SELECT *, {', '.join(f'x{i} AS p{i}' for i, x in enumerate(ODD.axes) if x.bounded().family == 'uniform')} FROM {name}_x)),
{name} AS (SELECT id, {', '.join(last)} FROM {name}_c)"""


LF = log_density_sql(["t0", "t1", "t2"])
UNIT = f"un AS (SELECT o_orderkey AS id, {', '.join(uniform_sql("o_orderkey", 11 + i) + f" AS u{i}" for i in range(3))} FROM orders)"
REFERENCE = f"""{UNIT}, {through_odd_sql('un', 'ref')}, rl AS (SELECT id, {LF} AS lf FROM ref), cut AS (SELECT quantile_cont(lf, 0.1) AS c FROM rl WHERE lf > '-Infinity'::DOUBLE)"""
UNIFORM = """ref AS (SELECT id, 1.0::DOUBLE + 49.0::DOUBLE * u0 AS t0, 0.10::DOUBLE * u1 AS t1, 0.08::DOUBLE * u2 AS t2 FROM un)"""
SCORED = f"""{views.EVALUATIONS}, {REFERENCE}, sc AS (SELECT ev.*, {LF} AS lf, ({LF}) <= c AS is_rare FROM ev, cut)"""
SEEDS = f"{SCORED}, ps AS (SELECT arm, seed, 100.0::DOUBLE * count(*) FILTER (margin < 0 AND is_rare) / greatest(count(margin), 1) AS score FROM sc GROUP BY 1, 2)"
WILSON = """least(1.0, greatest(0.0, (p + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)))"""


def wilson_sql(source: str, by: str, condition: str = "margin < 0") -> str:
    """by, n_valid, n_invalid, n_failures, p, p_lo, p_hi."""
    return f"""SELECT {by}, n_valid, n_invalid, n_failures, round(p, 6) AS p, round({WILSON.format(sign='-')}, 6) AS p_lo, round({WILSON.format(sign='+')}, 6) AS p_hi FROM
 (SELECT *, n_valid::DOUBLE AS n, CASE WHEN n_valid > 0 THEN n_failures / n_valid::DOUBLE END AS p FROM (SELECT {by}, count(margin) AS n_valid, count(*) FILTER (margin IS NULL) AS n_invalid, count(*) FILTER ({condition}) AS n_failures FROM {source} GROUP BY {by}))"""


def uniform_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of the box, one draw for each order."""
    u = design.uniform_design(views.table(spark, sf_dir, "orders"), 3, "o_orderkey", salt=11)
    return u.select("point_id", design.to_bounds(F.col("u"), ODD.lower, ODD.upper).alias("theta"))


def operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from the operational distribution: the same uniforms through the marginals' inverse CDFs.

    The inverse CDFs are the dear part, so bare ids are spread over all cores first.
    """
    ids = views.table(spark, sf_dir, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)
    u = design.uniform_design(ids, 3, "o_orderkey", salt=11)
    return u.select("point_id", design.through_odd(F.col("u"), ODD).alias("theta"))


def log_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, lf) of the reference sample of the operational distribution, computed once and kept."""
    return stored(operational(spark, sf_dir).select("point_id", odd.log_density(ODD, F.col("theta")).alias("lf")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations with their log density, rare where it is at most the cut: a single row that joins them all."""
    cut = exact_quantiles(log_densities(spark, sf_dir).where(F.col("lf") > float("-inf")), F.col("lf"), {"cut": 0.10}, [])
    points = views.evaluations(spark, sf_dir).withColumn("lf", odd.log_density(ODD, F.col("theta")))
    return points.join(F.broadcast(cut), F.lit(True), "left").withColumn("is_rare", F.col("lf") <= F.col("cut")).drop("cut")


def tidy(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, "n_valid", "n_invalid", "n_failures", r6("p", "p"), r6("p_lo", "p_lo"), r6("p_hi", "p_hi"))


@query("e1_failure_rate", f"WITH {views.EVALUATIONS} {wilson_sql('ev', 'arm')}")
def _(spark, sf_dir):
    return tidy(rates.failure_rate(views.evaluations(spark, sf_dir), ["arm"]), "arm")


@query("e2_severity_top", f"""WITH {views.EVALUATIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY margin, point_id, t0, t1, t2) AS rank, count(*) OVER (PARTITION BY arm) AS n FROM ev WHERE margin < 0)
SELECT arm, rank::BIGINT AS rank, round(margin, 6) AS margin FROM f WHERE rank <= greatest(1, ceil(n * 0.05))""")
def _(spark, sf_dir):
    top = rates.severity_top(views.evaluations(spark, sf_dir), "arm", 0.05)
    return top.select("arm", F.col("rank").cast("long").alias("rank"), r6("margin", "margin"))


@query("e4_log_density", f"WITH {views.EVALUATIONS} SELECT point_id, round(t0, 6) AS t0, round({LF}, 6) AS log_density FROM ev")
def _(spark, sf_dir):
    return views.evaluations(spark, sf_dir).select("point_id", r6(F.col("theta")[0], "t0"), r6(odd.log_density(ODD, F.col("theta")), "log_density"))


@query("e5_rarity_cut", f"WITH {REFERENCE} SELECT (SELECT count(*) FROM rl) AS n, round(c, 6) AS cut FROM cut")
def _(spark, sf_dir):
    ref = log_densities(spark, sf_dir)
    cut = exact_quantiles(ref.where(F.col("lf") > float("-inf")), F.col("lf"), {"cut": 0.10}, [])
    return ref.agg(F.count("*").alias("n")).join(F.broadcast(cut), F.lit(True), "left").select("n", r6("cut", "cut"))


@query("e6_odd_percentile", f"""WITH {SCORED}, q AS (SELECT DISTINCT lf FROM sc WHERE margin < 0), a AS (SELECT lf, 1 AS r FROM rl UNION ALL SELECT lf, 0 FROM q),
s AS (SELECT lf, r, sum(r) OVER (ORDER BY lf RANGE UNBOUNDED PRECEDING) - sum(r) OVER (PARTITION BY lf) AS below FROM a)
SELECT round(lf, 6) AS lf, round(below * 100.0::DOUBLE / (SELECT count(*) FROM rl), 6) AS odd_percentile FROM s WHERE r = 0""")
def _(spark, sf_dir):
    got = rates.operational_percentile(evaluated(spark, sf_dir).where("margin < 0"), log_densities(spark, sf_dir), "lf")
    return got.select(r6("lf", "lf"), r6("odd_percentile", "odd_percentile"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.evaluations(spark, sf_dir).withColumn("lf", odd.log_density(ODD, F.col("theta")))


@query("e7_rare_failures", f"WITH {SCORED} SELECT arm, point_id, round(margin, 6) AS margin, round(lf, 6) AS lf FROM sc WHERE margin < 0 AND is_rare")
def _(spark, sf_dir):
    return scored(spark, sf_dir).where("margin < 0 AND is_rare").select("arm", "point_id", r6("margin", "margin"), r6("lf", "lf"))


@query("e8_monte_carlo", f"""WITH {UNIT}, {UNIFORM}, m AS (SELECT 'uniform' AS design, 0.9 - (t0 / 100 + t1 * 4 + t2 * 4.37) AS margin FROM ref) {wilson_sql('m', 'design')}""")
def _(spark, sf_dir):
    t = F.col("theta")
    got = uniform_box(spark, sf_dir).select(F.lit("uniform").alias("design"), (0.9 - (t[0] / 100 + t[1] * 4 + t[2] * 4.37)).alias("margin"))
    return tidy(rates.failure_rate(got, ["design"]), "design")


@query("e10_rate_by_bin", f"WITH {views.EVALUATIONS}, b AS (SELECT *, CAST(floor((t0 - 1) / 5) AS INTEGER) AS bin FROM ev WHERE floor((t0 - 1) / 5) < 9) {wilson_sql('b', 'bin')}")
def _(spark, sf_dir):
    return tidy(rates.rate_by_bin(views.evaluations(spark, sf_dir), F.col("theta")[0], 1.0, 5.0, 9), "bin")


G1 = "arm, count(margin) AS n_valid, count(*) FILTER (margin < 0) AS n_failures, count(*) FILTER (margin < 0 AND is_rare) AS n_rare, round(min(margin), 6) AS worst_margin, round(quantile_cont(margin, 0.05), 6) AS margin_q05"


@query("g1_arm_scores", f"WITH {SCORED}, g AS (SELECT {G1} FROM sc GROUP BY arm) SELECT *, round(100.0 * n_failures / n_valid, 6)::DOUBLE AS failures_per_100, round(100.0 * n_rare / n_valid, 6)::DOUBLE AS rare_per_100 FROM g")
def _(spark, sf_dir):
    s = ranking.arm_scores(scored(spark, sf_dir))
    return s.select("arm", "n_valid", "n_failures", "n_rare", *[r6(c, c) for c in ("worst_margin", "margin_q05", "failures_per_100", "rare_per_100")])


@query("g2_leaderboard", f"WITH {SCORED}, g AS (SELECT {G1} FROM sc GROUP BY arm) SELECT arm, round(100.0 * n_rare / n_valid, 6)::DOUBLE AS rare_per_100, row_number() OVER (ORDER BY n_rare / n_valid::DOUBLE DESC, arm) AS rank FROM g")
def _(spark, sf_dir):
    board = ranking.leaderboard(ranking.arm_scores(scored(spark, sf_dir)), "rare_per_100")
    return board.select("arm", r6("rare_per_100", "rare_per_100"), F.col("rank").cast("long").alias("rank"))


@query("g3_per_seed", f"WITH {SEEDS} SELECT arm, seed, round(score, 6) AS score FROM ps")
def _(spark, sf_dir):
    return ranking.per_seed(scored(spark, sf_dir)).select("arm", "seed", r6("score", "score"))


@query("g4_seed_pairs", f"""WITH {SEEDS}, c AS (SELECT seed FROM ps GROUP BY seed HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM ps))
SELECT x.arm AS arm_a, y.arm AS arm_b, seed, round(x.score, 6) AS a, round(y.score, 6) AS b FROM ps x JOIN ps y USING (seed) JOIN c USING (seed) WHERE x.arm < y.arm""")
def _(spark, sf_dir):
    return ranking.common_seed_pairs(ranking.per_seed(scored(spark, sf_dir))).select("arm_a", "arm_b", "seed", r6("a", "a"), r6("b", "b"))


def normal_tail_sql(z: str) -> str:
    """1 - Phi(z) for z >= 0."""
    return f"(exp(-({z}) * ({z}) / 2) * {_poly_sql(odd.CDF_TOP, f'({z})')} / {_poly_sql(odd.CDF_LOW, f'({z})')})"


def signed_rank_sql(source: str, by: str) -> str:
    """CTEs over ``source`` (by, d): tests (by, n, wins, w_plus, p). dp holds how many subsets of the first m ranks have each sum."""
    return f"""dp AS (SELECT 0 AS m, [1.0::DOUBLE] AS ways UNION ALL SELECT m + 1, list_transform(range(1, len(ways) + m + 2), lambda i: coalesce(ways[i], 0) + CASE WHEN i > m + 1 THEN ways[i - m - 1] ELSE 0 END) FROM dp WHERE m < 50),
sz AS (SELECT {by}, abs(d) AS s, count(*) AS t, count(*) FILTER (d > 0) AS up FROM {source} WHERE isfinite(d) AND d <> 0 GROUP BY {by}, abs(d)),
rk AS (SELECT *, sum(t) OVER (PARTITION BY {by} ORDER BY s) - t + (t + 1) / 2.0::DOUBLE AS r FROM sz), wp AS (SELECT {by}, sum(t)::BIGINT AS m, sum(r * up) AS w, sum(t * t * t - t)::DOUBLE AS ties, max(t) AS most FROM rk GROUP BY {by}),
nn AS (SELECT {by}, count(*) FILTER (isfinite(d)) AS n, count(*) FILTER (isfinite(d) AND d > 0) AS wins FROM {source} GROUP BY {by}),
zz AS (SELECT wp.*, sqrt(wp.m * (wp.m + 1) * (2 * wp.m + 1) / 24.0::DOUBLE - ties / 48) AS sd, least(w, wp.m * (wp.m + 1) / 2.0::DOUBLE - w) AS tail, ways FROM wp LEFT JOIN dp ON dp.m = wp.m),
zt AS (SELECT *, CASE WHEN sd > 0 THEN abs(w - m * (m + 1) / 4.0::DOUBLE) / sd ELSE 0.0::DOUBLE END AS z FROM zz),
tests AS (SELECT {by}, n, wins, CASE WHEN n >= 2 THEN w END AS w_plus, CASE WHEN n >= 2 THEN CASE WHEN m <= 50 AND most = 1 THEN least(1.0, 2 * list_sum(ways[1 : floor(tail)::INT + 1]) / pow(2, m)) ELSE 2 * {normal_tail_sql('z')} END END AS p FROM nn LEFT JOIN zt USING ({by}))"""


PAIRED = f"""{SEEDS}, na AS (SELECT count(DISTINCT arm) AS n FROM ps), cs AS (SELECT seed FROM ps GROUP BY seed HAVING count(DISTINCT arm) = (SELECT n FROM na)),
pp AS (SELECT x.arm AS arm_a, y.arm AS arm_b, x.score - y.score AS d FROM ps x JOIN ps y USING (seed) JOIN cs USING (seed) WHERE x.arm < y.arm), {signed_rank_sql('pp', 'arm_a, arm_b')}"""
HOLM = f"""{PAIRED}, hr AS (SELECT *, row_number() OVER w AS i, count(p) OVER (PARTITION BY p IS NULL) AS k FROM tests WINDOW w AS (PARTITION BY p IS NULL ORDER BY p, arm_a, arm_b)),
hm AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(least(1.0, (k - i + 1) * p)) OVER (PARTITION BY p IS NULL ORDER BY i) END AS p_holm FROM hr)"""


@query("g5_paired_tests", f"WITH RECURSIVE {PAIRED} SELECT arm_a, arm_b, n, wins, w_plus, round(p, 6) AS p FROM tests")
def _(spark, sf_dir):
    got = ranking.paired_tests(ranking.common_seed_pairs(ranking.per_seed(scored(spark, sf_dir))), ["arm_a", "arm_b"])
    return got.withColumn("p", F.round("p", 6))


@query("g6_holm", f"WITH RECURSIVE {HOLM} SELECT 'c' AS campaign, arm_a, arm_b, n, wins, w_plus, round(p, 6) AS p, round(p_holm, 6) AS p_holm, coalesce(p_holm < 0.05, false) AS significant, round(pow(2, 1 - n), 6) AS smallest_p FROM hm")
def _(spark, sf_dir):
    tests = ranking.paired_tests(ranking.common_seed_pairs(ranking.per_seed(scored(spark, sf_dir))), ["arm_a", "arm_b"])
    got = ranking.holm(tests.withColumn("campaign", F.lit("c")), ["campaign"]).withColumn("smallest_p", ranking.smallest_p(F.col("n")))
    return got.withColumns({c: F.round(c, 6) for c in ("p", "p_holm", "smallest_p")})


SEQUENCE = f"""{SEEDS}, ar AS (SELECT DISTINCT arm FROM ps), pl AS (SELECT row_number() OVER (ORDER BY x.arm, y.arm) - 1 AS pos, x.arm AS a, y.arm AS b FROM ar x JOIN ar y ON x.arm < y.arm),
fd AS (SELECT pos, x.score AS x, y.score AS y, x.score - y.score AS d FROM pl JOIN ps x ON x.arm = a JOIN ps y ON y.arm = b AND y.seed = x.seed), {signed_rank_sql('fd', 'pos')},
mo AS (SELECT pos, max(greatest(abs(x), abs(y))) AS largest FROM fd GROUP BY pos),
us AS (SELECT pl.*, n, wins, largest, CASE WHEN p IS NULL THEN NULL WHEN wins * 2 > n THEN p / 2 ELSE 1.0::DOUBLE END AS pu FROM pl LEFT JOIN tests USING (pos) LEFT JOIN mo USING (pos)),
sq AS (SELECT *, coalesce(min(coalesce(pu < 0.05, false)::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS open FROM us)"""


@query("g8_fixed_sequence", f"""WITH RECURSIVE {SEQUENCE} SELECT pos, a || '|' || b AS id, a, b, 'a>b' AS direction, n, wins, round(pu, 6) AS p_used,
 CASE WHEN open = 0 THEN 'not tested' WHEN largest = 0 THEN 'void' WHEN pu < 0.05 THEN 'rejected' ELSE 'not rejected' END AS status FROM sq""")
def _(spark, sf_dir):
    seeds = ranking.per_seed(scored(spark, sf_dir))
    arms = seeds.select("arm").distinct()
    plan = arms.withColumnRenamed("arm", "a").join(arms.withColumnRenamed("arm", "b"), F.col("a") < F.col("b"))
    plan = plan.select((F.row_number().over(Window.orderBy("a", "b")) - 1).cast("long").alias("pos"), F.concat_ws("|", "a", "b").alias("id"), "a", "b", F.lit("a>b").alias("direction"))
    return ranking.fixed_sequence(plan, seeds).withColumn("p_used", F.round("p_used", 6))


@query("g10_run_rows", f"WITH {views.EVALUATIONS} SELECT arm, seed, count(margin) AS n_evaluations, count(*) FILTER (margin < 0) AS n_failures, round(min(margin), 6) AS worst_margin, round(quantile_cont(margin, 0.05), 6) AS margin_q05 FROM ev GROUP BY 1, 2")
def _(spark, sf_dir):
    return ranking.run_rows(views.evaluations(spark, sf_dir)).select("arm", "seed", "n_evaluations", "n_failures", r6("worst_margin", "worst_margin"), r6("margin_q05", "margin_q05"))


STATS = {"p_mean": "avg(p_fail)", "p_std": "coalesce(stddev_samp(p_fail), 0)", "failures_mean": "avg(n_failures)", "failures_std": "coalesce(stddev_samp(n_failures), 0)", "min_margin": "min(worst_margin)", "cv": "coalesce(stddev_samp(p_fail), 0) / nullif(avg(p_fail), 0)"}


@query("g11_arm_statistics", f"WITH {views.RUNS} SELECT arm, count(*) AS n_seeds, {', '.join(f'round({v}, 6) AS {k}' for k, v in STATS.items())} FROM rs GROUP BY arm")
def _(spark, sf_dir):
    return ranking.arm_statistics(views.run_summary(spark, sf_dir)).select("arm", "n_seeds", *[r6(c, c) for c in STATS])


#: Arms are arm<priority>[design]; each family has both designs.
DESIGNS = f"""{views.RUNS}, lo AS (SELECT arm[:4] AS family, arm[6 : len(arm) - 1] AS design, seed, UNNEST(['n_failures', 'worst_margin', 'p_fail']) AS metric, UNNEST([n_failures::DOUBLE, worst_margin::DOUBLE, p_fail]) AS v FROM rs),
lr AS (SELECT x.family, x.metric, x.v AS x, y.v AS y, CASE WHEN x.metric = 'worst_margin' THEN y.v - x.v ELSE x.v - y.v END AS d FROM lo x JOIN lo y USING (family, seed, metric) WHERE x.design = 'lhs' AND y.design = 'random'),
{signed_rank_sql('lr', 'family, metric')}, me AS (SELECT family, metric, avg(x) AS xm, coalesce(stddev_samp(x), 0) AS xs, avg(y) AS ym, coalesce(stddev_samp(y), 0) AS ys FROM lr GROUP BY ALL)"""


@query("g12_lhs_vs_random", f"WITH RECURSIVE {DESIGNS} SELECT family, metric, n, wins, w_plus, round(p, 6) AS p, round(xm, 4) AS lhs_mean, round(xs, 4) AS lhs_sd, round(ym, 4) AS random_mean, round(ys, 4) AS random_sd FROM tests JOIN me USING (family, metric) WHERE n >= 2")
def _(spark, sf_dir):
    got = ranking.lhs_vs_random(views.run_summary(spark, sf_dir), {"n_failures": 1, "worst_margin": -1, "p_fail": 1})
    return got.withColumns({"p": F.round("p", 6)} | {c: F.round(c, 4) for c in ("lhs_mean", "lhs_sd", "random_mean", "random_sd")})


RANKED = "(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE AS r_{n} FROM {src})"


def student_sql(source: str) -> str:
    """CTEs over one row (n, rho) of ``source``: stu (n, rho, p), by the finite series of the t distribution with n - 2 degrees."""
    factor = "(1 - rho * rho) * CASE WHEN n % 2 = 0 THEN (2 * k + 1) / (2 * k + 2)::DOUBLE ELSE (2 * k + 2) / (2 * k + 3)::DOUBLE END"
    return f"""sr AS (SELECT 0 AS k, 1.0::DOUBLE AS c, 1.0::DOUBLE AS s UNION ALL SELECT k + 1, c * f, s + c * f FROM (SELECT k, c, s, {factor} AS f FROM sr, {source} WHERE k + 1 <= CASE WHEN n % 2 = 0 THEN (n - 2) // 2 - 1 ELSE (n - 5) // 2 END)),
stu AS (SELECT n, rho, CASE WHEN rho = 0 THEN 1 WHEN abs(rho) >= 1 THEN 0 WHEN n % 2 = 0 THEN 1 - abs(rho) * s ELSE 1 - 2 / pi() * (asin(abs(rho)) + CASE WHEN n > 3 THEN abs(rho) * sqrt(1 - rho * rho) * s ELSE 0 END) END AS p FROM {source}, (SELECT arg_max(s, k) AS s FROM sr))"""


@query("g13_drift_by_arm", f"""WITH {views.RUNS}, x AS {RANKED.format(by='arm', c='seed', n='x', src='rs')}, y AS {RANKED.format(by='arm', c='n_failures', n='y', src='x')}
SELECT arm, count(*) AS n, round(corr(r_x, r_y), 6) AS rho FROM y GROUP BY arm""")
def _(spark, sf_dir):
    return ranking.spearman(views.run_summary(spark, sf_dir), "seed", "n_failures", ["arm"], 5).select("arm", "n", r6("rho", "rho"))


#: Runs in the order of their seeds, arms mixed within a seed.
ORDERED = f"{views.RUNS}, ro AS (SELECT 'all' AS one, *, row_number() OVER (ORDER BY seed, arm) AS run_index FROM rs)"


@query("g13_drift", f"""WITH RECURSIVE {ORDERED}, x AS {RANKED.format(by='one', c='run_index', n='x', src='ro')}, y AS {RANKED.format(by='one', c='n_failures', n='y', src='x')}, co AS (SELECT count(*) AS n, corr(r_x, r_y) AS rho FROM y), {student_sql('co')},
bl AS (SELECT 1 + count(*) FILTER (arm <> before) AS blocks, count(DISTINCT arm) AS arms FROM (SELECT arm, lag(arm) OVER (ORDER BY run_index) AS before FROM ro))
SELECT n AS n_runs, round(rho, 6) AS rho, round(p, 6) AS p, blocks > arms AS interleaved, rho IS NOT NULL AS computable, coalesce(p < 0.05, false) AS drift_detected FROM stu, bl WHERE n >= 5""")
def _(spark, sf_dir):
    runs = views.run_summary(spark, sf_dir).withColumn("run_index", F.row_number().over(Window.orderBy("seed", "arm")))
    return ranking.drift(runs).withColumns({"rho": F.round("rho", 6), "p": F.round("p", 6)})


@query("g14_learning_share", f"""WITH {SEEDS}, w AS (SELECT seed, max(score) FILTER (arm = 'active_boundary[lhs]') AS f, max(score) FILTER (arm = 'cross_entropy[random]') AS a, max(score) FILTER (arm = 'plain_sampling[lhs]') AS p FROM ps GROUP BY seed)
SELECT seed, round(CASE WHEN f - p <> 0 THEN (f - a) / (f - p) END, 6) AS share FROM w""")
def _(spark, sf_dir):
    return ranking.learning_share(ranking.per_seed(scored(spark, sf_dir)), "active_boundary[lhs]", "cross_entropy[random]", "plain_sampling[lhs]").select("seed", r6("share", "share"))


RUN_ORDER = """o AS (SELECT o_orderkey, o_orderpriority AS arm, CAST(o_custkey % 12 AS INTEGER) AS seed, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 12, o_orderkey) - 1 AS pos FROM orders),
r AS (SELECT arm, seed, count(*) + CASE WHEN seed = 0 AND arm LIKE '5%' THEN 1 ELSE 0 END AS n FROM o GROUP BY 1, 2), c AS (SELECT arm, seed, sum(n) OVER w AS stop, sum(n) OVER w - n AS start FROM r WINDOW w AS (PARTITION BY arm ORDER BY seed)),
k AS (SELECT arm FROM (SELECT arm, sum(n) AS n FROM r GROUP BY 1) JOIN (SELECT arm, count(*) AS m FROM o GROUP BY 1) USING (arm) WHERE n = m)"""


@query("g15_seeds_from_order", f"WITH {RUN_ORDER} SELECT o_orderkey, o.arm, c.seed, c.seed = o.seed AS same FROM o JOIN k ON k.arm = o.arm JOIN c ON c.arm = o.arm AND pos >= start AND pos < stop")
def _(spark, sf_dir):
    """Each point's seed, from run lengths alone; the arm whose runs have one evaluation too many is left out."""
    o = views.table(spark, sf_dir, "orders")
    own = (F.col("o_custkey") % 12).cast("int")
    spare = F.when((F.col("seed") == 0) & F.col("arm").startswith("5"), 1).otherwise(0)
    runs = o.groupBy(F.col("o_orderpriority").alias("arm"), own.alias("seed")).agg(F.count("*").alias("n")).select("arm", "seed", F.col("seed").alias("run_index"), (F.col("n") + spare).alias("n_evaluations"))
    pos = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.col("o_custkey") % 12, "o_orderkey")) - 1
    points = o.select("o_orderkey", F.col("o_orderpriority").alias("arm"), pos.alias("pos"), own.alias("own"))
    return ranking.seeds_from_run_order(runs, points).select("o_orderkey", "arm", "seed", (F.col("seed") == F.col("own")).alias("same"))


@query("g16_bounds_sanity", f"WITH {views.EVALUATIONS} SELECT arm, round(avg(CASE WHEN t0 < 2 OR t0 > 49 OR t1 > 0.095 OR t2 > 0.08 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS outside FROM ev GROUP BY arm")
def _(spark, sf_dir):
    return ranking.outside_share(views.evaluations(spark, sf_dir), [2.0, 0.0, 0.0], [49.0, 0.095, 0.08]).select("arm", r6("outside", "outside"))


@query("g18_same_margins", f"WITH {views.EVALUATIONS} SELECT arm, count(*) FILTER (margin < 0 AND seed = 3) AS n_breaches FROM ev GROUP BY arm")
def _(spark, sf_dir):
    ev = views.evaluations(spark, sf_dir)
    moved = ev.withColumn("margin", F.when((F.col("margin") < 0) & (F.col("seed") == 3), F.col("margin") - 1e-3).otherwise(F.col("margin")))
    return ranking.same_margins(ev, moved)


@query("g19_merge", f"WITH {views.EVALUATIONS} SELECT arm, count(*) AS n, round(avg(margin), 6) AS mean_margin FROM ev WHERE arm NOT LIKE 'plain%' GROUP BY arm")
def _(spark, sf_dir):
    ev = views.evaluations(spark, sf_dir).where("arm not like 'plain%'")
    return campaigns.merge_campaigns(ev.where("arm like '%[lhs]'"), ev).groupBy("arm").agg(F.count("*").alias("n"), r6(F.avg("margin"), "mean_margin"))


METRICS = f"""{views.TELEMETRY}, m AS (SELECT run_id, count(*) AS n_steps, max(abs(xte)) AS mx, max(abs(steering)) AS ms, avg(abs(steering)) AS av, min(step) FILTER (abs(xte) > 1.75) AS fn FROM st GROUP BY run_id),
mm AS (SELECT *, CASE WHEN n_steps >= 3 THEN 0.6 * (2.5 - mx) + 0.2 * (-least(1.0, greatest(0.0, (ms - av) / 0.4))) + 0.2 * (-(n_steps - coalesce(fn, n_steps)) / n_steps::DOUBLE) END AS margin FROM m)"""


@query("c2_composite_margin", f"WITH {METRICS} SELECT run_id, n_steps, round(mx, 6) AS max_xte, round(margin, 6) AS margin FROM mm")
def _(spark, sf_dir):
    m = telemetry.composite_margin(telemetry.run_metrics(views.telemetry(spark, sf_dir)))
    return m.select("run_id", "n_steps", r6("max_xte", "max_xte"), r6("margin", "margin"))


@query("c4_lost_runs", f"WITH {METRICS} SELECT count(*) AS n_runs, count(*) FILTER (n_steps IS NULL) AS n_lost, count(margin) AS n_valid FROM customer LEFT JOIN mm ON c_custkey = run_id")
def _(spark, sf_dir):
    runs = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    m = telemetry.complete_runs(runs, telemetry.composite_margin(telemetry.run_metrics(views.telemetry(spark, sf_dir))))
    return m.agg(F.count("*").alias("n_runs"), F.count_if(F.col("n_steps") == 0).alias("n_lost"), F.count("margin").alias("n_valid"))


@query("c3_invalidity", f"""WITH {METRICS}, f AS (SELECT *, run_id % 7 > 4 AS bad, (run_id * 3) % 20 + 1 AS hz FROM mm)
SELECT count(*) FILTER (n_steps < 3) AS degenerate, count(*) FILTER (bad) AS inconsistent, count(*) FILTER (hz < 5) AS low_fidelity, count(*) FILTER (margin IS NOT NULL AND NOT bad AND hz >= 5) AS n_valid FROM f""")
def _(spark, sf_dir):
    m = telemetry.composite_margin(telemetry.run_metrics(views.telemetry(spark, sf_dir)))
    m = m.withColumns({"min_speed": F.col("run_id") % 7, "max_speed": F.lit(4), "control_hz": ((F.col("run_id") * 3) % 20 + 1).cast("double"), "meters_per_step": F.lit(None).cast("double")})
    v = telemetry.invalidity(m, min_hz=5.0)
    return v.agg(*[F.count_if(c).alias(c) for c in ("degenerate", "inconsistent", "low_fidelity")], F.count("margin").alias("n_valid"))


@query("c5_loop_fidelity", f"""WITH {views.TELEMETRY}, f AS (SELECT run_id, avg(speed_kmh) AS v, count(*) AS n, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS el FROM st GROUP BY run_id)
SELECT run_id, round(CASE WHEN el > 0 THEN n / el END, 6) AS control_hz, round(CASE WHEN el > 0 THEN v / 3.6 * el / n END, 4) AS meters_per_step FROM f""")
def _(spark, sf_dir):
    st = views.telemetry(spark, sf_dir)
    el = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    g = st.groupBy("run_id").agg(F.avg("speed_kmh").alias("v"), F.count("*").alias("n"), el.alias("el"))
    hz, m = telemetry.loop_fidelity(F.col("el"), F.col("n"), F.col("v"))
    return g.select("run_id", r6(hz, "control_hz"), F.round(m, 4).alias("meters_per_step"))


@query("c12_failure_mode", f"""WITH {views.TELEMETRY}, g AS (SELECT run_id, min(xte) AS lo, max(xte) AS hi, avg(CASE WHEN abs(xte) > 0.2 THEN sign(steering) * sign(xte) END) AS ag, count(*) AS n, arg_max(xte, step) AS l FROM st GROUP BY run_id)
SELECT run_id, CASE WHEN lo < -1 AND hi > 1 THEN 'oscillation' WHEN ag > 0.15 THEN 'wrong-way' WHEN n > 10 THEN 'late drift' ELSE 'drift' END AS mode, CASE WHEN l < 0 THEN 'left' ELSE 'right' END AS side FROM g""")
def _(spark, sf_dir):
    return telemetry.failure_mode(views.telemetry(spark, sf_dir))


@query("c10_cut_in", f"WITH {views.TELEMETRY} SELECT run_id, round(coalesce(min(speed_kmh) FILTER (abs(xte) < 0.3), 'Infinity'::DOUBLE) - 1.5, 6) AS margin FROM st GROUP BY run_id")
def _(spark, sf_dir):
    st = views.telemetry(spark, sf_dir).select("run_id", (F.abs("xte") / 0.3 * 1.75).alias("lat_gap"), F.col("speed_kmh").alias("long_gap"))
    return telemetry.cut_in_margin(st).select("run_id", r6("margin", "margin"))


@query("c9_braking", f"WITH {views.TELEMETRY} SELECT run_id, round(80.0 - arg_max(speed_kmh, step) - 2.0, 6) AS margin FROM st GROUP BY run_id")
def _(spark, sf_dir):
    st = views.telemetry(spark, sf_dir).withColumn("position", F.col("speed_kmh"))
    params = st.select("run_id").distinct().withColumn("detection_dist", F.lit(80.0))
    return telemetry.braking_margin(st, params).select("run_id", r6("margin", "margin"))


@query("b1_uniform_design", f"SELECT o_orderkey AS point_id, {', '.join(f'round({uniform_sql('o_orderkey', s)}, 6) AS u{s - 1}' for s in (1, 2, 3))} FROM orders")
def _(spark, sf_dir):
    u = design.uniform_design(views.table(spark, sf_dir, "orders"), 3, "o_orderkey")
    return u.select("point_id", *[r6(F.col("u")[i], f"u{i}") for i in range(3)])


LHS = ", ".join(f"round((row_number() OVER (PARTITION BY c_nationkey ORDER BY {uniform_sql('c_custkey', 1 + j)}, c_custkey) - 1 + {uniform_sql('c_custkey', 3 + j)}) / count(*) OVER (PARTITION BY c_nationkey), 6) AS u{j}" for j in range(2))


@query("b2_latin_hypercube", f"SELECT c_nationkey, c_custkey AS point_id, {LHS} FROM customer")
def _(spark, sf_dir):
    d = design.latin_hypercube(views.table(spark, sf_dir, "customer"), 2, "c_nationkey", "c_custkey")
    return d.select("c_nationkey", "point_id", *[r6(F.col("u")[i], f"u{i}") for i in range(2)])


def turn_sql(v: str, salt: str) -> str:
    one = f"(({v} * 48271 + {salt} * 69621 + 12345) % 2147483647)"
    return f"(({one} * {one} + {v}) % 2147483647)"


#: The permutation by recursion: a round a step, until a whole number of permutations has brought the number back into range.
LARGE = f"""n AS (SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 1 ELSE CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 END AS a FROM lineitem), d AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM n),
w AS (SELECT id, axis, 0 AS i, id // b AS l, id % b AS r FROM d, range((SELECT n FROM d)) g(id), range(2) x(axis)
 UNION ALL SELECT id, axis, i + 1, CASE WHEN i % 2 = 0 THEN (l + {turn_sql('r', '(i % 6 + (5 + axis) * 6)')}) % a ELSE l END, CASE WHEN i % 2 = 0 THEN r ELSE (r + {turn_sql('l', '(i % 6 + (5 + axis) * 6)')}) % b END
 FROM w, d WHERE NOT (i > 0 AND i % 6 = 0 AND l * b + r < n)), s AS (SELECT id, axis, l * b + r AS stratum, n FROM w, d WHERE i > 0 AND i % 6 = 0 AND l * b + r < n)"""


@query("b2_large_hypercube", f"""WITH RECURSIVE {LARGE} SELECT x.id AS point_id, {', '.join(f'round(({t}.stratum + {uniform_sql("x.id", 7 + j)}) / {t}.n, 6) AS u{j}' for j, t in enumerate('xy'))} FROM s x JOIN s y ON x.id = y.id AND x.axis = 0 AND y.axis = 1""")
def _(spark, sf_dir):
    """One hypercube with as many points as there are evaluations."""
    n = views.table(spark, sf_dir, "lineitem").count()
    d = design.large_latin_hypercube(spark.range(n), n, 2, "id", salt=5)
    return d.select("point_id", *[r6(F.col("u")[i], f"u{i}") for i in range(2)])


@query("b3_to_bounds", f"SELECT o_orderkey AS point_id, {', '.join(f'round({lo!r} + {hi - lo!r}::DOUBLE * {uniform_sql('o_orderkey', 11 + i)}, 6) AS t{i}' for i, (lo, hi) in enumerate(zip(ODD.lower, ODD.upper)))} FROM orders")
def _(spark, sf_dir):
    return uniform_box(spark, sf_dir).select("point_id", *[r6(F.col("theta")[i], f"t{i}") for i in range(3)])


@query("b4_through_odd", f"WITH {UNIT}, {through_odd_sql('un', 'ref')} SELECT id AS point_id, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM ref")
def _(spark, sf_dir):
    return operational(spark, sf_dir).select("point_id", *[r6(F.col("theta")[i], f"t{i}") for i in range(3)])


@query("b7_payload", f"WITH {views.EVALUATIONS} SELECT point_id, CAST(round_even(t0 / 4, 0) AS INTEGER) AS q, 250 AS map FROM ev")
def _(spark, sf_dir):
    p = design.payload(F.array(F.col("theta")[0] / 4), ["q", "map"], {"map": 250})
    return views.evaluations(spark, sf_dir).select("point_id", p.alias("p")).select("point_id", "p.*")


@query("b11_detection", f"""WITH d AS (SELECT c_nationkey AS rep, {uniform_sql('c_custkey', 1)} AS x, {uniform_sql('c_custkey', 2)} AS y FROM customer), h AS (SELECT rep, bool_or(x < 0.1 AND y < 0.1) AS found FROM d GROUP BY rep)
SELECT 'random' AS design, round(avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS detection, count(*) AS n_reps FROM h""")
def _(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    u = design.uniform_design(c, 2, "c_custkey").join(c.select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("rep")), "point_id").withColumn("design", F.lit("random"))
    got = design.detection_rate(u, (F.col("u")[0] < 0.1) & (F.col("u")[1] < 0.1))
    return got.select("design", r6("detection", "detection"), "n_reps")


PAIRS = f"""{views.POINTS}, fp AS (SELECT * FROM pt WHERE margin < 0), pr AS (SELECT x.point_id AS a, y.point_id AS b, sqrt(pow(x.u0 - y.u0, 2) + pow(x.u1 - y.u1, 2) + pow(x.u2 - y.u2, 2) + pow(x.u3 - y.u3, 2)) AS dist FROM fp x JOIN fp y ON x.point_id < y.point_id),
nk AS (SELECT dist FROM (SELECT a, dist FROM pr UNION ALL SELECT b, dist FROM pr) QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist) = 2),
ep AS (SELECT ceil(coalesce(nullif(quantile_cont(dist, 0.5), 0), 0.5) * 1e6) / 1e6 AS eps FROM nk), pe AS (SELECT a, b, dist FROM pr, ep WHERE dist <= eps)"""


def failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.region_points(spark, sf_dir).where("margin < 0")


def radius(failed: DataFrame) -> float:
    """The radius of all region queries: estimated from the failing points."""
    return regions.estimated_eps(failed, 4, digits=6)


@query("h3_eps_pairs", f"WITH {PAIRS} SELECT a, b, round(dist, 6) AS dist FROM pe")
def _(spark, sf_dir):
    points = failing(spark, sf_dir)
    return regions.eps_pairs(points, radius(points)).select("a", "b", r6("dist", "dist"))


GRAPH = f"""{PAIRS}, e AS (SELECT a, b FROM pe UNION ALL SELECT b, a FROM pe), r AS (SELECT point_id, point_id AS root FROM fp UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.point_id WHERE e.b > r.root),
rg AS (SELECT point_id, min(root) AS region FROM r GROUP BY point_id)"""


@query("h4_regions", f"WITH RECURSIVE {GRAPH} SELECT point_id, region FROM rg")
def _(spark, sf_dir):
    return found_regions(spark, sf_dir)


def found_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = failing(spark, sf_dir)
    return regions.dbscan(points, radius(points))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing(spark, sf_dir).join(found_regions(spark, sf_dir), "point_id")


@query("h5_region_records", f"""WITH RECURSIVE {GRAPH} SELECT region, count(*) AS n, round(min(margin), 6) AS worst_margin, round(avg(margin), 6) AS mean_margin, string_agg(DISTINCT owner, '|' ORDER BY owner) AS owners, count(*) = 1 AS is_singleton,
 {', '.join(f'round(avg(u{i}), 6) AS c{i}, round(greatest(0, min(u{i}) - 0.02), 6) AS lo{i}, round(least(1, max(u{i}) + 0.02), 6) AS hi{i}' for i in range(4))} FROM rg JOIN fp USING (point_id) GROUP BY region""")
def _(spark, sf_dir):
    r = regions.region_records(members(spark, sf_dir), 4)
    cols = [c for i in range(4) for c in (r6(F.col("centroid")[i], f"c{i}"), r6(F.col("box_lower")[i], f"lo{i}"), r6(F.col("box_upper")[i], f"hi{i}"))]
    return r.select("region", "n", r6("worst_margin", "worst_margin"), r6("mean_margin", "mean_margin"), F.array_join("owners", "|").alias("owners"), "is_singleton", *cols)


@query("h7_hit_probability")
def _(spark, sf_dir):
    r = regions.rarest_first(regions.region_records(members(spark, sf_dir), 4))
    return r.select("region_no", "region", "n", "constraining_axes", "p_hit_uniform", regions.draws_for_half(F.col("p_hit_uniform")).alias("n50"), regions.hit_chance(F.col("p_hit_uniform"), 120).alias("hit_120"))


@query("h12_exclusive", f"WITH RECURSIVE {GRAPH}, d AS (SELECT DISTINCT owner, region FROM rg JOIN fp USING (point_id)), x AS (SELECT region, count(*) AS n, min(owner) AS owner FROM d GROUP BY region) SELECT owner, count(*) AS n_exclusive FROM x WHERE n = 1 GROUP BY owner")
def _(spark, sf_dir):
    return regions.exclusive_regions(regions.discoveries(members(spark, sf_dir)))


@query("h13_overlaps", f"""WITH RECURSIVE {GRAPH}, d AS (SELECT DISTINCT owner, region FROM rg JOIN fp USING (point_id)), s AS (SELECT owner, count(*) AS n FROM d GROUP BY owner),
p AS (SELECT x.owner AS a, y.owner AS b, x.n AS na, y.n AS nb, (SELECT count(*) FROM d i JOIN d j USING (region) WHERE i.owner = x.owner AND j.owner = y.owner) AS shared FROM s x JOIN s y ON x.owner < y.owner)
SELECT a, b, shared, na - shared AS only_a, nb - shared AS only_b, round(shared / (na + nb - shared)::DOUBLE, 6) AS jaccard FROM p""")
def _(spark, sf_dir):
    return regions.overlaps(regions.discoveries(members(spark, sf_dir))).select("a", "b", "shared", "only_a", "only_b", r6("jaccard", "jaccard"))


@query("h14_coverage", f"""WITH {PAIRS}, e AS (SELECT a, b FROM pe UNION ALL SELECT b, a FROM pe), s AS (SELECT owner, count(*) AS n FROM fp GROUP BY owner),
h AS (SELECT x.owner, y.owner AS other, count(DISTINCT x.point_id) AS hit FROM e JOIN fp x ON x.point_id = e.a JOIN fp y ON y.point_id = e.b WHERE x.owner <> y.owner GROUP BY 1, 2)
SELECT s.owner, t.owner AS other, round(coalesce(hit, 0) / s.n::DOUBLE, 6) AS coverage FROM s JOIN s t ON s.owner <> t.owner LEFT JOIN h ON h.owner = s.owner AND h.other = t.owner""")
def _(spark, sf_dir):
    p = failing(spark, sf_dir)
    return regions.coverage(p, regions.eps_pairs(p, radius(p))).select("owner", "other", r6("coverage", "coverage"))


@query("h15_axis_spread", f"WITH {PAIRS} SELECT axis, spread FROM (SELECT {', '.join(f'round(max(u{i}) - min(u{i}), 6) AS s{i}' for i in range(4))} FROM fp), LATERAL (VALUES {', '.join(f'({i}, s{i})' for i in range(4))}) v(axis, spread)")
def _(spark, sf_dir):
    return regions.axis_spread(failing(spark, sf_dir)).select("axis", r6("spread", "spread"))


@query("i1_shared_design", f"""WITH {views.BACKENDS}, f AS (SELECT scenario_idx, t0 AS x FROM br WHERE backend = 'fast'), g AS (SELECT scenario_idx, t0 + (scenario_idx % 3) * 0.2 AS y FROM br WHERE backend = 'full')
SELECT count(*) AS n, count(*) FILTER (x IS NULL OR y IS NULL) AS n_alone, round(max(abs(x - y)), 6) AS max_delta, coalesce(bool_and(abs(x - y) <= 0.51), false) AS same FROM f FULL JOIN g USING (scenario_idx)""")
def _(spark, sf_dir):
    b = views.backend_runs(spark, sf_dir)
    full = b.where("backend = 'full'").withColumn("theta", F.array(F.col("theta")[0] + (F.col("scenario_idx") % 3) * 0.2))
    got = sweeps.shared_design(b.where("backend = 'fast'"), full)
    return got.select("n", "n_alone", r6("max_delta", "max_delta"), "same")


@query("i2_backend_spearman", f"""WITH RECURSIVE {views.BACKENDS}, j AS (SELECT 'all' AS pair, f.margin AS x, g.margin AS y FROM br f JOIN br g USING (scenario_idx) WHERE f.backend = 'fast' AND g.backend = 'full' AND f.valid AND g.valid),
x AS {RANKED.format(by='pair', c='x', n='x', src='j')}, y AS {RANKED.format(by='pair', c='y', n='y', src='x')}, co AS (SELECT count(*) AS n, corr(r_x, r_y) AS rho FROM y), {student_sql('co')} SELECT 'all' AS pair, n, round(rho, 6) AS rho, round(p, 6) AS p FROM stu""")
def _(spark, sf_dir):
    b = views.backend_runs(spark, sf_dir).where("valid")
    both = b.where("backend = 'fast'").select("scenario_idx", F.col("margin").alias("x")).join(b.where("backend = 'full'").select("scenario_idx", F.col("margin").alias("y")), "scenario_idx")
    return ranking.rank_correlation(both, "x", "y").select(F.lit("all").alias("pair"), "n", r6("rho", "rho"), r6("p", "p"))


@query("i3_backend_summary", f"WITH {views.BACKENDS} SELECT backend, count(*) FILTER (valid) AS n_valid, round(count(*) FILTER (valid AND margin < 0) / count(*) FILTER (valid)::DOUBLE, 6) AS failure_rate, quantile_cont(control_hz, 0.5) AS median_hz FROM br GROUP BY backend")
def _(spark, sf_dir):
    return sweeps.backend_summary(views.backend_runs(spark, sf_dir)).select("backend", "n_valid", r6("failure_rate", "failure_rate"), "median_hz")


ENVELOPE = f"{views.BACKENDS}, lim AS (SELECT min(control_hz) AS lo, max(control_hz) AS hi FROM br), eb AS (SELECT *, CAST(least(floor((control_hz - lo) / ((hi - lo) / 8)), 7) AS INTEGER) AS bin FROM br, lim)"


@query("j1_envelope", f"WITH {ENVELOPE} {wilson_sql('eb', 'bin')}")
def _(spark, sf_dir):
    return tidy(sweeps.envelope(views.backend_runs(spark, sf_dir), "control_hz", 8), "bin")


@query("j2_crossing", f"""WITH {views.EVALUATIONS}, g AS (SELECT t0 AS x, avg(CASE WHEN margin < 0.2 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM ev WHERE margin IS NOT NULL GROUP BY t0), l AS (SELECT *, lag(x) OVER (ORDER BY x) AS x0, lag(p) OVER (ORDER BY x) AS p0 FROM g)
SELECT round(x0 + (0.5 - p0) / (p - p0) * (x - x0), 6) AS threshold FROM l WHERE (p0 - 0.5) * (p - 0.5) <= 0 AND p <> p0 ORDER BY x LIMIT 1""")
def _(spark, sf_dir):
    g = views.evaluations(spark, sf_dir).where("margin is not null").groupBy(F.col("theta")[0].alias("x")).agg(F.avg((F.col("margin") < 0.2).cast("double")).alias("p"))
    return sweeps.crossing(g).select(r6("threshold", "threshold"))


@query("j3_sweep", f"""WITH {views.EVALUATIONS} SELECT CAST(floor(t0 / 10) AS BIGINT) AS angle_max, CAST(floor(t1 * 100 / 3) AS BIGINT) AS speed_max, round(100.0 * count(*) FILTER (margin < 0) / nullif(count(margin), 0), 6)::DOUBLE AS fail_pct, count(margin) AS n_valid, round(quantile_cont(margin, 0.5), 6) AS median_margin FROM ev GROUP BY 1, 2""")
def _(spark, sf_dir):
    t = F.col("theta")
    cells = views.evaluations(spark, sf_dir).select(F.floor(t[0] / 10).alias("angle_max"), F.floor(t[1] * 100 / 3).alias("speed_max"), "margin")
    return sweeps.sweep_summary(cells).select("angle_max", "speed_max", r6("fail_pct", "fail_pct"), "n_valid", r6("median_margin", "median_margin"))


@query("j4_repeatability", f"""WITH {views.BACKENDS}, p AS (SELECT scenario_idx, count(margin) AS n, bool_and(margin < 0) AS af, bool_or(margin < 0) AS an, stddev_samp(margin) AS sd, max(margin) - min(margin) AS rg, avg(margin) AS mean FROM br GROUP BY 1)
SELECT count(*) AS n_points, count(*) FILTER (af) AS n_fail, count(*) FILTER (NOT an) AS n_pass, count(*) FILTER (an AND NOT af) AS n_flipped, round(quantile_cont(sd, 0.5), 6) AS median_sd, round(max(rg), 6) AS max_range, count(*) FILTER (an AND NOT af AND abs(mean) < 0.2) AS n_near_flips FROM p WHERE n = 2""")
def _(spark, sf_dir):
    got = sweeps.repeatability(views.backend_runs(spark, sf_dir).withColumnRenamed("scenario_idx", "point_id"), 2)
    return got.select("n_points", "n_fail", "n_pass", "n_flipped", r6("median_sd", "median_sd"), r6("max_range", "max_range"), "n_near_flips")


@query("d7_drivability", """WITH r AS (SELECT CASE WHEN p_size < 1 THEN 1e4 ELSE least(1e4, greatest(15.0, 20.0 / radians(p_size))) END AS radius, 10.0 + p_size % 12 AS speed FROM part), s AS (SELECT scale, pow(speed * scale, 2) / radius AS a FROM r, (VALUES (0.5::DOUBLE), (1.0), (1.5)) v(scale))
SELECT scale, round(avg(CASE WHEN a > 0.8 * 9.81 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS over_share, round(quantile_cont(a, 0.5), 6) AS median_a FROM s GROUP BY scale""")
def _(spark, sf_dir):
    roads = views.table(spark, sf_dir, "part").select(sweeps.turn_radius(F.col("p_size").cast("double"), F.lit(20.0)).alias("radius"), (10.0 + F.col("p_size") % 12).alias("speed"))
    return sweeps.drivability(roads, [0.5, 1.0, 1.5]).select("scale", r6("over", "over_share"), r6("median_a", "median_a"))


@query("d8_episode_budget", "SELECT p_partkey, CAST(ceil(least(120.0, greatest(10.0, p_retailprice / (5.0 + p_size) * 1.5)) * 9.0) AS BIGINT) AS steps FROM part")
def _(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", sweeps.episode_steps(F.col("p_retailprice"), 5.0 + F.col("p_size"), 9.0).alias("steps"))


@query("f1_importance", f"""WITH {SCORED}, w AS (SELECT arm, margin, 1 / (0.1 + 0.9 * exp(-4.0 - lf)) AS w FROM sc WHERE margin IS NOT NULL)
SELECT arm, round(avg(CASE WHEN margin < 0 THEN w ELSE 0.0 END), 5) AS p, round(sum(w) * sum(w) / sum(w * w), 3) AS ess, count(*) AS n FROM w GROUP BY arm""")
def _(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("w", importance.defensive_weight(F.lit(-4.0), F.col("lf"), 0.1))
    return importance.weighted_failure(s, ["arm"]).select("arm", F.round("p", 5).alias("p"), F.round("ess", 3).alias("ess"), "n")


def normal_cdf_sql(z: str) -> str:
    return f"CASE WHEN {z} > 0 THEN 1 - {normal_tail_sql(f'abs({z})')} ELSE {normal_tail_sql(f'abs({z})')} END"


#: The scores of a Gaussian prediction of deviation 0.2 around each margin; the best margin so far is -0.1.
SCORES = f"""{views.EVALUATIONS}, zs AS (SELECT arm, point_id, -margin / 0.2::DOUBLE AS z, -0.1::DOUBLE - margin - 0.01::DOUBLE AS gain FROM ev WHERE margin IS NOT NULL), zp AS (SELECT *, gain / 0.2::DOUBLE AS y FROM zs),
pf AS (SELECT *, {normal_cdf_sql('z')} AS p, {normal_cdf_sql('y')} AS q FROM zp)"""


@query("f7_surrogate_scores", f"WITH {SCORES} SELECT arm, point_id, round(p, 6) AS p_fail, round(-(p * ln(p + 1e-9) + (1 - p) * ln(1 - p + 1e-9)), 6) AS entropy, round(gain * q + 0.2::DOUBLE * exp(-y * y / 2) / 2.5066282746310002::DOUBLE, 6) AS ei FROM pf")
def _(spark, sf_dir):
    ev = views.evaluations(spark, sf_dir)
    p = importance.failure_probability(F.col("margin"), F.lit(0.2))
    return ev.where("margin is not null").select("arm", "point_id", r6(p, "p_fail"), r6(importance.binary_entropy(p), "entropy"), r6(importance.expected_improvement(F.col("margin"), F.lit(0.2), -0.1), "ei"))


@query("f13_best_so_far", f"""WITH {views.EVALUATIONS}, e AS (SELECT DISTINCT arm, seed, point_id, margin FROM (SELECT arm, seed, point_id, min(margin) AS margin FROM ev GROUP BY 1, 2, 3)) SELECT arm, seed, point_id, round(min(margin) OVER (PARTITION BY arm, seed ORDER BY point_id ROWS UNBOUNDED PRECEDING), 6) AS best FROM e""")
def _(spark, sf_dir):
    ev = views.evaluations(spark, sf_dir).groupBy("arm", "seed", "point_id").agg(F.min("margin").alias("margin")).withColumn("run", F.concat_ws("/", "arm", "seed"))
    return sweeps.best_so_far(ev, "run", "point_id").select("arm", "seed", "point_id", r6("best", "best"))


@query("f14_worst_case", f"WITH {views.EVALUATIONS} SELECT arm, rank, point_id, round(margin, 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY margin, point_id) AS rank FROM (SELECT arm, point_id, min(margin) AS margin FROM ev WHERE margin IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 8")
def _(spark, sf_dir):
    points = views.evaluations(spark, sf_dir).where("margin is not null").groupBy("arm", "point_id").agg(F.min("margin").alias("margin"))
    return sweeps.worst_cases(points, 8).select("arm", F.col("rank").cast("long").alias("rank"), "point_id", r6("margin", "margin"))


WINDOW = f"WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, (50 - value) / 50 AS margin FROM events) {wilson_sql('w', 'start')}"


@query("k3_windowed_rate", WINDOW)
def _(spark, sf_dir):
    from ..streaming.live import windowed_failure_rate

    ev = views.table(spark, sf_dir, "events").withColumn("margin", (50 - F.col("value")) / 50)
    return tidy(windowed_failure_rate(ev, "ts", "1 hour").withColumn("start", F.col("win.start")), "start")


@query("d3_road_frame", f"""WITH {views.FRAMES} SELECT run_id, tick, part, round(lat, 6) AS "lateral", round(atan2(sin(turn), cos(turn)), 6) AS heading_error, round(s, 6) AS s, i = 10 AND t >= 1 - 1e-9 AS beyond_end, i = 0 AND t <= 1e-9 AS before_start FROM fr""")
def _(spark, sf_dir):
    got = roads.road_frame(views.drives(spark, sf_dir), views.roads(spark, sf_dir))
    return got.select("run_id", "tick", "part", *[r6(c, c) for c in ("lateral", "heading_error", "s")], "beyond_end", "before_start")


@query("d4_headings", f"""WITH {views.ROADS}, {views.DRIVES}, mv AS (SELECT *, px - lag(px) OVER w AS ex, py - lag(py) OVER w AS ey FROM dr WINDOW w AS (PARTITION BY run_id ORDER BY tick, part, px, py)),
ow AS (SELECT *, CASE WHEN sqrt(ex * ex + ey * ey) >= 1e-6 THEN atan2(ey, ex) END AS own FROM mv)
SELECT run_id, tick, part, round(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY tick, part, px, py ROWS UNBOUNDED PRECEDING), atan2(dy, dx)), 6) AS yaw FROM ow JOIN (SELECT run_id, dx, dy FROM sg WHERE i = 0) USING (run_id)""")
def _(spark, sf_dir):
    return roads.headings(views.drives(spark, sf_dir).drop("yaw"), views.roads(spark, sf_dir), ["tick", "part", "px", "py"]).select("run_id", "tick", "part", r6("yaw", "yaw"))


@query("d5_lateral_agreement", f"""WITH {views.FRAMES}, x AS (SELECT run_id, lat, lat * 0.95 + (tick % 7 - 3) / 10.0::DOUBLE AS xte FROM fr)
SELECT run_id, round(max(abs(abs(xte) - abs(lat))), 6) AS max_diff, round(avg(CASE WHEN abs(xte) > 0.05 AND abs(lat) > 0.05 THEN CASE WHEN sign(xte) = sign(lat) THEN 1.0::DOUBLE ELSE 0.0 END END), 6) AS same_sign FROM x GROUP BY run_id""")
def _(spark, sf_dir):
    got = roads.road_frame(views.drives(spark, sf_dir), views.roads(spark, sf_dir)).withColumn("xte", F.col("lateral") * 0.95 + (F.col("tick") % 7 - 3) / F.lit(10.0))
    return roads.lateral_agreement(got).select("run_id", r6("max_diff", "max_diff"), r6("same_sign", "same_sign"))


@query("d6_road_parity", f"""WITH {views.ROADS}, bu AS (SELECT run_id, i, x AS px, y2 AS py, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y2 - lag(y2) OVER w, 2)), 0) AS leg FROM ve WHERE run_id % 7 <> 0 WINDOW w AS (PARTITION BY run_id ORDER BY i)),
bs AS (SELECT row_number() OVER () AS rid, run_id, px, py, sum(leg) OVER (PARTITION BY run_id ORDER BY i) AS along, sum(leg) OVER (PARTITION BY run_id) AS total FROM bu), {views.NEAREST.format(p='bs')},
pr AS (SELECT run_id, count(*) FILTER (along > 2 AND along < total - 2) >= 10 AS part, avg(d) AS m, max(d) AS x, avg(d) FILTER (along > 2 AND along < total - 2) AS im, max(d) FILTER (along > 2 AND along < total - 2) AS ix, max(total) AS total FROM nr GROUP BY run_id),
rl AS (SELECT run_id, sum(len) AS len FROM sg GROUP BY run_id)
SELECT rl.run_id, round(CASE WHEN part THEN im ELSE m END, 6) AS mean_dev, round(CASE WHEN part THEN ix ELSE x END, 6) AS max_dev, round(total / len, 6) AS length_ratio, coalesce(CASE WHEN part THEN ix ELSE x END <= 0.1, false) AS ok FROM rl LEFT JOIN pr ON rl.run_id = pr.run_id""")
def _(spark, sf_dir):
    got = roads.parity(views.roads(spark, sf_dir), views.roads(spark, sf_dir, 0.03).where("run_id % 7 <> 0"))
    return got.select("run_id", r6("mean_dev", "mean_dev"), r6("max_dev", "max_dev"), r6("length_ratio", "length_ratio"), "ok")


@query("d9_curvature", f"""WITH {views.ROADS}, tr AS (SELECT a.run_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM ve a JOIN ve b ON a.run_id = b.run_id AND b.i = a.i + 2 JOIN ve c ON a.run_id = c.run_id AND c.i = a.i + 4 WHERE a.i < 12 - 5),
dt AS (SELECT *, (x1 - x2) * (y2 - y3) - (x2 - x3) * (y1 - y2) AS det, (x1 * x1 + y1 * y1 - x2 * x2 - y2 * y2) / 2 AS bc, (x2 * x2 + y2 * y2 - x3 * x3 - y3 * y3) / 2 AS cd FROM tr),
ra AS (SELECT run_id, CASE WHEN abs(det) >= 1e-6 THEN sqrt(pow((bc * (y2 - y3) - cd * (y1 - y2)) / det - x1, 2) + pow(((x1 - x2) * cd - (x2 - x3) * bc) / det - y1, 2)) END AS radius FROM dt)
SELECT run_id, round(coalesce(1 / min(radius), 0), 6) AS curvature FROM ra GROUP BY run_id""")
def _(spark, sf_dir):
    return roads.curvature(views.roads(spark, sf_dir)).select("run_id", r6("curvature", "curvature"))


@query("c18_fidelity_report", f"""WITH {views.BACKENDS}, r AS (SELECT *, scenario_idx % 17 + 1.0::DOUBLE AS infer_ms, scenario_idx % 29 + CASE WHEN backend = 'fast' THEN 0.0::DOUBLE ELSE 9.0 END AS wait_ms FROM br),
g AS (SELECT backend, min(control_hz) AS hz_min, quantile_cont(control_hz, 0.5) AS hz_median, max(control_hz) AS hz_max, quantile_cont(infer_ms, 0.5) AS infer_ms, quantile_cont(wait_ms, 0.5) AS wait_ms, count(*) FILTER (NOT valid) AS n_invalid FROM r GROUP BY backend)
SELECT *, round(CASE WHEN infer_ms + wait_ms > 0 THEN wait_ms / (infer_ms + wait_ms) * 100 END, 6) AS wait_share, CASE WHEN wait_ms >= infer_ms THEN 'simulator' ELSE 'inference' END AS bottleneck FROM g""")
def _(spark, sf_dir):
    idx = F.col("scenario_idx")
    b = views.backend_runs(spark, sf_dir).withColumns({"infer_ms": idx % 17 + F.lit(1.0), "wait_ms": idx % 29 + F.when(F.col("backend") == "fast", 0.0).otherwise(9.0)})
    return sweeps.fidelity_report(b, "backend").withColumn("wait_share", F.round("wait_share", 6))


@query("i5_caveats", f"""WITH {views.BACKENDS}, s AS (SELECT backend, avg(CASE WHEN valid THEN CASE WHEN margin < 0 THEN 1.0::DOUBLE ELSE 0.0 END END) AS rate, quantile_cont(control_hz, 0.5) AS hz, CASE WHEN backend = 'fast' THEN 0.3625 ELSE 0.36 END AS scale FROM br GROUP BY backend),
d AS (SELECT coalesce(bool_and(abs(f.t0 - (g.t0 + (g.scenario_idx % 3) * 0.3)) <= 0.51), false) AS same FROM (SELECT * FROM br WHERE backend = 'fast') f FULL JOIN (SELECT * FROM br WHERE backend = 'full') g USING (scenario_idx))
SELECT subject, caveat FROM (SELECT backend AS subject, CASE WHEN rate IS NULL THEN 'no valid run' WHEN rate <= 0 THEN '0% failures' WHEN rate >= 1 THEN '100% failures' END AS caveat FROM s
 UNION ALL SELECT 'all', CASE WHEN count(DISTINCT round(scale, 4)) > 1 THEN 'different speed_scale' END FROM s UNION ALL SELECT 'all', CASE WHEN count(*) >= 2 AND max(hz) / greatest(min(hz), 1e-9) > 1.5 THEN 'different control rates' END FROM s
 UNION ALL SELECT 'fast|full', CASE WHEN NOT same THEN 'different designs' END FROM d) WHERE caveat IS NOT NULL""")
def _(spark, sf_dir):
    b = views.backend_runs(spark, sf_dir)
    summary = sweeps.backend_summary(b).withColumn("speed_scale", F.when(F.col("backend") == "fast", 0.3625).otherwise(0.36))
    full = b.where("backend = 'full'").withColumn("theta", F.array(F.col("theta")[0] + (F.col("scenario_idx") % 3) * 0.3))
    return sweeps.comparison_caveats(summary, sweeps.shared_design(b.where("backend = 'fast'"), full).select(F.lit("fast|full").alias("pair"), "same"))


LOCAL = f"""{GRAPH}, rb AS (SELECT region, count(*) AS n, {', '.join(f'least(1, max(u{i}) + 0.02) - greatest(0, min(u{i}) - 0.02) AS s{i}' for i in range(4))} FROM rg JOIN fp USING (point_id) GROUP BY region),
rc AS (SELECT *, n >= 4 AND (least(s0, s1, s2, s3) < 0.5 * (n - 1) / (n + 1)) AS local, CASE WHEN n >= 4 THEN {' * '.join(f'CASE WHEN s{i} < 0.5 * (n - 1) / (n + 1) THEN s{i} ELSE 1.0 END' for i in range(4))} END AS p FROM rb)"""


@query("h11_structure_score")
def _(spark, sf_dir):
    ready(spark)
    points = failing(spark, sf_dir).select("point_id", "u")
    return regions.structure_score(points, 4, radius(points))


@query("h17_sampler_verdict", f"""WITH RECURSIVE {LOCAL}, ow AS (SELECT point_id, owner AS family, CASE WHEN point_id % 2 = 0 THEN 'lhs' ELSE 'random' END AS design FROM fp),
bo AS (SELECT family FROM ow GROUP BY family HAVING count(DISTINCT design) = 2),
pe2 AS (SELECT family, region, CAST(bool_or(design = 'lhs') AS INT) AS l, CAST(bool_or(design = 'random') AS INT) AS r FROM ow JOIN rg USING (point_id) JOIN rc USING (region) WHERE local GROUP BY 1, 2),
fs AS (SELECT family, sum(l) AS l, sum(r) AS r, count(*) AS pool, sum(l * r) AS shared FROM pe2 GROUP BY family), al AS (SELECT family, coalesce(l, 0) AS l, coalesce(r, 0) AS r, coalesce(pool, 0) AS pool, coalesce(shared, 0) AS shared FROM bo LEFT JOIN fs USING (family))
SELECT family, CAST(l AS BIGINT) AS localised_lhs, CAST(r AS BIGINT) AS localised_random, CAST(l - shared AS BIGINT) AS only_lhs, CAST(r - shared AS BIGINT) AS only_random,
 CASE WHEN pool = 0 THEN 'n/a' WHEN abs(l - r) < 2 OR abs(l - r) / pool::DOUBLE < 0.3 THEN 'tie' WHEN l > r THEN 'lhs' ELSE 'random' END AS verdict FROM al""")
def _(spark, sf_dir):
    design_of = F.when(F.col("point_id") % 2 == 0, "[lhs]").otherwise("[random]")
    owned = members(spark, sf_dir).withColumn("owner", F.concat("owner", design_of)).checkpoint()
    local = regions.region_records(owned, 4).where(F.size("constraining_axes") > 0)
    return regions.sampler_verdict(owned.select("owner").distinct(), regions.discoveries(owned), local)


@query("h18_rare_regime", f"""WITH RECURSIVE {LOCAL}, sp AS (SELECT least({', '.join(f'max(u{i}) - min(u{i})' for i in range(4))}) AS m FROM fp)
SELECT round((SELECT m FROM sp), 6) AS min_spread, count(*) FILTER (local) AS n_localised, round(coalesce(sum(CASE WHEN local THEN n ELSE 0 END) / sum(n)::DOUBLE, 0.0), 6) AS localised_share, coalesce((SELECT m FROM sp) < 0.9, false) AS rare_regime FROM rc""")
def _(spark, sf_dir):
    got = regions.regime(failing(spark, sf_dir), regions.region_records(members(spark, sf_dir), 4))
    return got.select(r6("min_spread", "min_spread"), "n_localised", r6("localised_share", "localised_share"), "rare_regime")


@query("h18_rarest_regions", f"WITH RECURSIVE {LOCAL} SELECT region, n, round(p, 6) AS p_hit FROM rc WHERE p IS NOT NULL ORDER BY p, region LIMIT 5")
def _(spark, sf_dir):
    return regions.rarest(regions.region_records(members(spark, sf_dir), 4), 5).select("region", "n", r6("p_hit_uniform", "p_hit"))


def unit(theta: Column) -> Column:
    return F.array(*[(theta[i] - a.lower) / (a.upper - a.lower) for i, a in enumerate(ODD.axes)])


def given_surrogate(spark: SparkSession, sf_dir: str) -> surrogate.Surrogate:
    """Trained on the mean of every (seed, quantity) cell: 12 x 50 points at most, made from all evaluations."""
    import numpy as np

    u = unit(F.col("theta"))
    cells = views.evaluations(spark, sf_dir).where("margin is not null").groupBy("seed", F.col("theta")[0].alias("q"))
    rows = cells.agg(*[F.avg(u[i]).alias(f"u{i}") for i in range(3)], F.avg("margin").alias("margin")).orderBy("seed", "q").collect()
    points = np.array([[r["u0"], r["u1"], r["u2"]] for r in rows], float).reshape(-1, 3)
    return surrogate.Surrogate.given(points, np.array([r["margin"] for r in rows], float), np.array([0.2, 0.4, 0.4]))


def scored_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = uniform_box(spark, sf_dir).select("point_id", unit(F.col("theta")).alias("u"))
    return surrogate.score_pool(pool, given_surrogate(spark, sf_dir))


@query("f9_diverse_batch")
def _(spark, sf_dir):
    ready(spark)
    score = importance.binary_entropy(importance.failure_probability(F.col("mu"), F.col("sigma")))
    return surrogate.diverse_batch(scored_pool(spark, sf_dir).withColumn("score", score), 16, 0.5 / math.sqrt(3))


@query("f10_posterior")
def _(spark, sf_dir):
    return scored_pool(spark, sf_dir).select("point_id", "mu", "sigma")


@query("f11_integrated_probability")
def _(spark, sf_dir):
    draws = operational(spark, sf_dir).select("point_id", unit(F.col("theta")).alias("u"))
    return surrogate.integrated_probability(surrogate.score_pool(draws, given_surrogate(spark, sf_dir)))


@query("f12_axis_importance", f"""WITH {views.EVALUATIONS}, le AS (SELECT 'quantity' AS name, stddev_pop((t0 - 1) / 49.0::DOUBLE) AS l FROM ev UNION ALL SELECT 'discount', stddev_pop(t1 / 0.10::DOUBLE) FROM ev UNION ALL SELECT 'tax', stddev_pop(t2 / 0.08::DOUBLE) FROM ev),
iv AS (SELECT name, 1 / greatest(l, 1e-9) AS v FROM le) SELECT name, round(v / sum(v) OVER (), 6) AS importance FROM iv""")
def _(spark, sf_dir):
    u = unit(F.col("theta"))
    spread = views.evaluations(spark, sf_dir).agg(*[F.stddev_pop(u[i]).alias(a.name) for i, a in enumerate(ODD.axes)])
    lengths = spread.select(F.explode(F.array(*[F.struct(F.lit(a.name).alias("name"), F.col(a.name).alias("length")) for a in ODD.axes])).alias("x")).select("x.*")
    return surrogate.axis_importance(lengths).select("name", r6("importance", "importance"))


from . import extra, streams  # noqa: E402, F401  (they register further queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arm yields most rare failures per 100 valid runs?"""
    return ranking.leaderboard(ranking.arm_scores(scored(spark, sf_dir)), "rare_per_100")
