"""Surrogate scores, diverse batches and the structure score against direct computation."""

import numpy as np
from pyspark.sql import functions as F

from rareflow.operators import regions, surrogate


def test_posterior_matches_direct_inversion(spark):
    rng = np.random.default_rng(1)
    x, q, lengths = rng.random((30, 2)), rng.random((50, 2)), np.array([0.3, 0.7])
    y = np.sin(4 * x[:, 0]) + x[:, 1]
    rows = [(i, list(map(float, p))) for i, p in enumerate(q)] + [(99, None), (98, [0.5])]
    got = {r.point_id: r for r in surrogate.score_pool(spark.createDataFrame(rows, "point_id long, u array<double>"), surrogate.Surrogate.given(x, y, lengths)).collect()}

    def k(a, b):
        return np.exp(-0.5 * (((a[:, None] - b[None]) / lengths) ** 2).sum(-1))

    inverse = np.linalg.inv(k(x, x) + 0.1 * np.eye(30))
    mu = y.mean() + y.std() * k(q, x) @ inverse @ ((y - y.mean()) / y.std())
    sigma = y.std() * np.sqrt(1.1 - np.einsum("ij,jk,ik->i", k(q, x), inverse, k(q, x)))
    assert got[99].mu is None and got[98].sigma is None
    for i in range(50):
        assert abs(got[i].mu - mu[i]) < 1e-6 and abs(got[i].sigma - sigma[i]) < 1e-6
    r = surrogate.integrated_probability(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "mu double, sigma double")).first()
    assert abs(r.p - 0.5) < 1e-12 and r.n == 2 and r.p_lo == r.p_hi


def test_diverse_batch(spark):
    rng = np.random.default_rng(2)
    u, score = rng.random((80, 2)), rng.integers(0, 20, 80) / 4
    table = spark.createDataFrame([(i, list(map(float, p)), float(s)) for i, (p, s) in enumerate(zip(u, score))], "point_id long, u array<double>, score double")
    for k, apart in ((5, 0.3), (12, 0.6), (90, 0.1)):
        order = sorted(range(80), key=lambda i: (-score[i], i))
        want = []
        for i in order:
            if len(want) < k and all(np.linalg.norm(u[i] - u[j]) >= apart for j in want):
                want.append(i)
        want += [i for i in order if i not in want][: k - len(want)]
        assert [r.point_id for r in surrogate.diverse_batch(table, k, apart).orderBy("rank").collect()] == want
    assert surrogate.diverse_batch(table.limit(0), 3, 0.1).count() == 0


def test_shuffled_copies_keep_marginals(spark):
    rng = np.random.default_rng(3)
    u = rng.random((40, 3))
    points = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(u)], "point_id long, u array<double>")
    rows = regions.shuffled_copies(points, 3, 4).collect()
    assert len(rows) == 160
    for c in range(1, 5):
        cloud = np.array([r.u for r in rows if r.copy == c])
        assert np.array_equal(np.sort(cloud, axis=0), np.sort(u, axis=0)) and not np.array_equal(np.sort(cloud[:, 0] + cloud[:, 1]), np.sort(u[:, 0] + u[:, 1]))


def share_in_groups(u: np.ndarray, eps: float, least: int = 4) -> float:
    near = np.linalg.norm(u[:, None] - u[None], axis=2) <= eps
    reach = np.linalg.matrix_power(near.astype(float), len(u)) > 0
    return float((reach.sum(axis=1) >= least).mean())


def test_structure_score(spark):
    rng = np.random.default_rng(4)

    def table(u):
        return spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(u)], "point_id long, u array<double>")

    tight = np.concatenate([0.05 * rng.random((12, 3)) + c for c in ([0.1, 0.1, 0.8], [0.8, 0.5, 0.1], [0.5, 0.9, 0.4])])
    for u, eps, structured in ((tight, 0.12, True), (rng.random((40, 3)), 0.2, False)):
        got = regions.structure_score(table(u), 3, eps, copies=8).first()
        copies = regions.shuffled_copies(table(u), 3, 8).collect()
        null = [share_in_groups(np.array([r.u for r in copies if r.copy == c]), eps) for c in range(1, 9)]
        assert abs(got.observed - share_in_groups(u, eps)) < 1e-9
        assert abs(got.null_mean - np.mean(null)) < 1e-9 and abs(got.null_std - np.std(null, ddof=1)) < 1e-9
        assert got.has_structure == structured == bool(got.z > 2)
    assert regions.structure_score(table(rng.random((7, 3))), 3, 0.12).first().asDict() == {"observed": 0, "null_mean": 0, "null_std": 0, "z": 0, "has_structure": False}


def test_sampler_verdict(spark):
    reach = [("a[lhs]", r) for r in (1, 2, 3, 4)] + [("a[random]", 1), ("b[lhs]", 1), ("b[random+x]", 2), ("c[lhs]", 3), ("d[lhs]", 9), ("d[random]", 9)]
    found = spark.createDataFrame(reach, "owner string, region long")
    got = regions.sampler_verdict(found.select("owner").distinct(), found, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "region long"))
    assert {r.family: (r.verdict, r.only_lhs, r.only_random) for r in got.collect()} == {"a": ("lhs", 3, 0), "b": ("tie", 1, 1), "d": ("n/a", 0, 0)}
    assert got.where(F.col("family") == "c").count() == 0


def test_integrated_probability_is_over_the_operational_distribution(spark):
    from statistics import NormalDist

    from rareflow.operators import design
    from rareflow.plans import queries
    from rareflow.sources import views

    at, z = "/root/testdata/sf0.001", NormalDist()
    draws = design.uniform_design(views.table(spark, at, "orders"), 3, "o_orderkey", salt=11).collect()

    def ppf(axis, p):
        a = axis.bounded()
        if a.family == "uniform":
            return a.lower + p * (a.upper - a.lower)
        lo, hi = z.cdf((a.lower - a.mu) / a.sigma), z.cdf((a.upper - a.mu) / a.sigma)
        return a.mu + a.sigma * z.inv_cdf(lo + p * (hi - lo))

    direct = [(r.point_id, [(ppf(a, p) - a.lower) / (a.upper - a.lower) for a, p in zip(queries.ODD.axes, r.u)]) for r in draws]
    table = spark.createDataFrame(direct, "point_id long, u array<double>")
    want = surrogate.integrated_probability(surrogate.score_pool(table, queries.given_surrogate(spark, at))).first()
    got = queries.QUERIES["f11_integrated_probability"](spark, at).first()
    assert got.n == want.n == len(direct) and abs(got.p - want.p) < 1e-6
