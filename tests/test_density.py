"""Clusters and neighbour distances against brute force, on sparse, dense, tied and skewed clouds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflow.operators import density

FORM = "point_id long, u array<double>"


def by_hand(cloud, eps, least):
    """Regions of all points from all distances."""
    ids, x = [i for i, _ in cloud], np.array([u for _, u in cloud])
    far = np.sqrt(sum((x[:, i, None] - x[None, :, i]) ** 2 for i in range(x.shape[1])))
    near = far <= eps
    core = near.sum(axis=1) >= least
    region, order = dict(zip(ids, ids, strict=True)), np.argsort(ids)
    seen = set()
    for i in order:
        if not core[i] or i in seen:
            continue
        stack, group = [i], {i}
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if j not in group:
                    group.add(j), stack.append(j)
        seen |= group
        for j in group:
            region[ids[j]] = ids[i]
    for i in np.flatnonzero(~core):
        found = [region[ids[j]] for j in np.flatnonzero(near[i] & core)]
        if found:
            region[ids[i]] = min(found)
    return region


def clouds():
    r = random.Random(5)
    spread = [[r.random() for _ in range(2)] for _ in range(150)]
    blobs = [[c + r.gauss(0, 0.03) for c in centre] for centre in ([0.2, 0.2, 0.2], [0.8, 0.8, 0.8], [0.25, 0.35, 0.3]) for _ in range(60)] + [[r.random() for _ in range(3)] for _ in range(40)]
    grid = [[i / 10, j / 10] for i in range(9) for j in range(9)]
    ties = [[0.5, 0.5, 0.5, 0.5]] * 30 + [[0.5, 0.5, 0.5, 0.6]] * 5 + [[r.choice([0.1, 0.2, 0.9]) for _ in range(4)] for _ in range(60)]
    line = [[0.004 * i] for i in range(100)] + [[2.0 + 0.05 * i] for i in range(9)]
    return {"spread": (spread, 0.07), "blobs": (blobs, 0.06), "grid": (grid, 0.1000001), "ties": (ties, 0.11), "line": (line, 0.0041), "one cell": (blobs, 9.0)}


@pytest.mark.parametrize("name,least", [("spread", 2), ("blobs", 1), ("blobs", 5), ("grid", 5), ("ties", 2), ("ties", 5), ("line", 2), ("one cell", 5)])
def test_dbscan(spark, name, least):
    points, eps = clouds()[name]
    ids = random.Random(3).sample(range(1000), len(points))
    cloud = list(zip(ids, points, strict=True))
    got = {r.point_id: r.region for r in density.dbscan(spark.createDataFrame(cloud, FORM).repartition(3), eps, least).collect()}
    assert got == by_hand(cloud, eps, least)


def test_core_cells_that_only_inner_points_link(spark):
    """Two dense cells whose facing points are too far apart, but for one pair that no axis shows; and two that nothing links."""
    r = random.Random(8)
    a = [[0.01 + r.random() * 0.005, 0.01 + r.random() * 0.005] for _ in range(30)]
    eps = 0.1
    far = [x + 0.085 for x in a[0]]  # sqrt(2) * 0.085 > eps
    b = [[far[0] + r.random() * 0.005, far[1] + r.random() * 0.005] for _ in range(30)]
    cloud = list(enumerate(a + b + [[x + 0.5 for x in p] for p in a] + [[x + 0.5 for x in p] for p in b] + [[0.049, 0.05]]))
    got = {x.point_id: x.region for x in density.dbscan(spark.createDataFrame(cloud, FORM), eps, 4).collect()}
    assert got == by_hand(cloud, eps, 4)
    assert got[0] == got[30] and got[60] != got[90]


def test_refined_finds_exactly_the_linked_cells(spark):
    r = random.Random(4)
    eps = 0.3
    side = eps / math.sqrt(2) * (1 - 1e-9)
    pairs = []
    for k in range(25):
        lot = [[side * r.random(), side * r.random()] for _ in range(6)], [[side * (2 + r.random()), side * (r.choice([0, 1]) + r.random())] for _ in range(6)]
        pairs.append(lot)
    points = spark.createDataFrame([(100 * k + 10 * s + i, u, [k, s]) for k, lot in enumerate(pairs) for s in (0, 1) for i, u in enumerate(lot[s])], FORM + ", cell array<long>")
    open_pairs = spark.createDataFrame([([k, 0], [k, 1], 100 * k, 100 * k + 10) for k in range(25)], "cell_a array<long>, cell_b array<long>, node_a long, node_b long")
    want = {100 * k for k, (a, b) in enumerate(pairs) if min(math.dist(x, y) for x in a for y in b) <= eps}
    assert 0 < len(want) < 25
    for levels in (1, 10):
        assert {x.node_a for x in density.refined(points, open_pairs, side, 2, eps, levels).collect()} == want


def test_clouds_of_different_groups_never_meet(spark):
    cloud = [(i, [0.5 + i / 1000]) for i in range(6)]
    df = spark.createDataFrame(cloud, FORM)
    got = {x.point_id: x.region for x in density.dbscan(df, 0.1, 2, by=F.col("point_id") % 2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1}
    assert density.dbscan(df.limit(0), 0.1).count() == 0


def test_a_cloud_inside_one_cell_is_linear(spark):
    df = spark.range(100_000).select(F.col("id").alias("point_id"), F.array(*[F.rand(i) * 0.04 for i in range(4)]).alias("u"))
    assert density.dbscan(df, 0.12, 5).select("region").distinct().collect()[0].region == 0


@pytest.mark.parametrize("name,k,leaf", [("spread", 1, 8), ("blobs", 2, 8), ("grid", 5, 16), ("ties", 2, 8), ("line", 2, 8), ("blobs", 2, 512)])
def test_neighbour_distances(spark, name, k, leaf):
    points, _ = clouds()[name]
    cloud = [*enumerate(points), (5000, [7.0] * len(points[0])), (5001, [-3.0] * len(points[0]))]
    got = {x.point_id: x.dist for x in density.neighbour_distances(spark.createDataFrame(cloud, FORM).repartition(3), len(points[0]), k, leaf).collect()}
    for i, u in cloud:
        assert got[i] == pytest.approx(sorted(math.dist(u, v) for j, v in cloud if j != i)[k - 1], abs=1e-12)


def test_neighbours_of_too_few(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], FORM)
    assert [x.dist for x in density.neighbour_distances(df, 1, 2).collect()] == [None, None]
    assert density.neighbour_distances(df.limit(0), 1, 2).count() == 0


def test_a_dense_corner_is_searched_in_its_own_scale(spark):
    df = spark.range(16_000).select(F.col("id").alias("point_id"), F.array(*[F.rand(i) * 0.05 for i in range(4)]).alias("u"))
    got = density.neighbour_distances(df, 4, 2)
    assert got.count() == 16_000 and got.agg(F.max("dist")).first()[0] < 0.05


@pytest.mark.parametrize("small", [0, 40, 10**6])
def test_connected(spark, small):
    r = random.Random(2)
    nodes, order = list(range(0, 600, 3)), list(range(0, 600, 3))
    r.shuffle(order)
    pairs = [(a, b) for a, b in zip(order[:120], order[1:120])] + [(r.choice(order[120:]), r.choice(order[120:])) for _ in range(40)]
    above = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            above[a] = above[b] = min(above[a], above[b])
    df = density.connected(spark.createDataFrame([(n,) for n in nodes], "point_id long"), spark.createDataFrame(pairs, "a long, b long").repartition(3), small)
    assert {x.point_id: x.region for x in df.collect()} == above


@pytest.mark.parametrize("inside", [1, 3, 50])
def test_exact_quantiles_under_ties(spark, inside):
    from rareflow.functions.ranges import exact_quantiles

    r = random.Random(7)
    groups = {"few": [r.choice([1.0, 2.0, 2.5]) for _ in range(500)], "wide": [r.lognormvariate(0, 40) for _ in range(700)], "one": [4.0], "same": [3.0] * 90, "edge": [0.0] * 50 + [1.0] * 50, "tied": [0.0] * 200 + [r.random() for _ in range(60)] + [1.0] * 200}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None)]
    r.shuffle(rows)
    shares = {"low": 0.05, "mid": 0.5, "high": 0.97, "top": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {x.g: x for x in exact_quantiles(df, F.col("v"), shares, ["g"], inside).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 97, 1000, 4097])
def test_large_hypercube_has_one_point_a_stratum(spark, n):
    from rareflow.operators import design

    u = np.array([x.u for x in design.large_latin_hypercube(spark.range(n), n, 3, "id").collect()])
    assert all(sorted(np.floor(u[:, j] * n).astype(int)) == list(range(n)) for j in range(3))
    if n >= 1000:
        assert abs(np.corrcoef(u.T)[0, 1:]).max() < 0.1 and abs(np.corrcoef(np.arange(n), u[:, 0])[0, 1]) < 0.1


def test_neighbouring_cells_by_leaves(spark):
    """All pairs of cells within the radius, once, within their group; no row for each step between cells, as there was before."""
    r = random.Random(8)
    rows = [(k, [r.gauss(0, 1) for _ in range(3)], k % 3) for k in range(240)]
    points = spark.createDataFrame(rows, "point_id long, u array<double>, g long")
    eps = 0.6
    side = eps / math.sqrt(3) * (1 - 1e-9)
    stats = density.stored(density.cell_stats(points.withColumn("cell", F.array("g", *[F.floor(F.col("u")[i] / side) for i in range(3)])), ["cell"], 3))
    cells = [(x.node, x.cell[0], x.lo, x.hi) for x in stats.collect()]
    gap = lambda a, b: math.sqrt(sum(max(0.0, b[2][i] - a[3][i], a[2][i] - b[3][i]) ** 2 for i in range(3)))
    want = sorted((a[0], b[0]) for a in cells for b in cells if a[0] < b[0] and a[1] == b[1] and gap(a, b) <= eps)
    for leaf in (8, 512):
        got = density.neighbouring_cells(stats, 3, eps, leaf)
        assert sorted((x.node_a, x.node_b) for x in got.collect()) == want and len(want) > 100
        assert "Generate explode" not in got._jdf.queryExecution().optimizedPlan().toString()
