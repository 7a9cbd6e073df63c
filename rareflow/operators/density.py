"""Density clusters and neighbour distances of points in space, at any density.

``dbscan`` works on the graph of occupied cells, not of points: all points of a cell lie within the radius of each
other, so a cell with enough points is one core node, and near pairs are never listed. ``neighbour_distances`` cuts
space into leaves of equal counts, so no radius has to be guessed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import discard, ready, stored


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def apart(a: Column, b: Column, dims: int) -> Column:
    """The same distance, written out for a known number of axes, which the JVM compiles."""
    return F.sqrt(sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(1, dims)), (a[0] - b[0]) * (a[0] - b[0])))


def box_gap(a: str, b: str, dims: int) -> Column:
    """Least distance of boxes (columns lo_<name>, hi_<name>)."""
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"lo_{b}")[i] - F.col(f"hi_{a}")[i], F.col(f"lo_{a}")[i] - F.col(f"hi_{b}")[i])
    return F.sqrt(sum((gap(i) * gap(i) for i in range(dims)), F.lit(0.0)))


def box_reach(a: str, b: str, dims: int) -> Column:
    """Greatest distance of two points of the boxes."""
    far = lambda i: F.greatest(F.abs(F.col(f"hi_{b}")[i] - F.col(f"lo_{a}")[i]), F.abs(F.col(f"hi_{a}")[i] - F.col(f"lo_{b}")[i]))
    return F.sqrt(sum((far(i) * far(i) for i in range(dims)), F.lit(0.0)))


def cell_stats(points: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """keys, n, node (the smallest id), lo, hi, and the points that lie lowest and highest on each axis."""
    u = [F.col("u")[i] for i in range(dims)]
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("point_id").alias("node"), F.array(*map(F.min, u)).alias("lo"), F.array(*map(F.max, u)).alias("hi"),
        F.array(*[F.min_by("u", x) for x in u]).alias("lowest"), F.array(*[F.max_by("u", x) for x in u]).alias("highest"),
    )


def side_of(stats: DataFrame, name: str) -> DataFrame:
    return stats.select(*[F.col(c).alias(f"{c}_{name}") for c in stats.columns])


def surely_near(a: str, b: str, dims: int, eps: float) -> Column:
    """True where the boxes, or their points that face each other on some axis, prove a pair within eps."""
    facing = [apart(F.col(f"{x}_{a}")[i], F.col(f"{y}_{b}")[i], dims) <= eps for i in range(dims) for x, y in (("highest", "lowest"), ("lowest", "highest"))]
    near = box_reach(a, b, dims) <= eps
    for f in facing:
        near = near | f
    return near


def near_boxes(eps: float):
    """For cogroups of visiting cells (node_a, lo_a, hi_a) and the cells of one leaf (node_b, lo_b, hi_b): pairs with boxes within eps."""

    def run(visitors: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(visitors) and len(cells):
            a, b = visitors["node_a"].to_numpy(), cells["node_b"].to_numpy()
            (lo_a, hi_a), (lo_b, hi_b) = ((np.stack(rows[f"lo_{x}"]), np.stack(rows[f"hi_{x}"])) for rows, x in ((visitors, "a"), (cells, "b")))
            for at in range(0, len(a), 512):
                part = slice(at, at + 512)
                gaps = (np.maximum(0.0, np.maximum(lo_b[None, :, i] - hi_a[part, None, i], lo_a[part, None, i] - hi_b[None, :, i])) for i in range(lo_a.shape[1]))
                x, y = np.nonzero((np.sqrt(sum(g * g for g in gaps)) <= eps) & (a[part, None] < b[None, :]))
                found.append(np.stack([a[part][x], b[y]], 1))
        return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), "int64"), columns=["node_a", "node_b"])

    return run


def neighbouring_cells(stats: DataFrame, dims: int, eps: float, leaf: int | None = None) -> DataFrame:
    """Pairs of different occupied cells (columns _a, _b) of one group whose boxes are within eps.

    Cells go into leaves of at most ``leaf`` by their lowest corners, the group being one more axis on which groups lie
    far apart. A cell visits the leaves that come near enough, found down the tree by equi-joins, with its box alone; what
    else is known of two cells joins the pairs that are left. In several dimensions most steps between cells lead to
    none, so cells are never multiplied by steps.
    """
    side = eps / math.sqrt(dims) * (1 + 1e-6)
    apart_by = 4 * (eps + side) + 1.0
    corner = F.concat(F.array(F.col("cell")[0] * F.lit(apart_by)), "lo")
    placed, tree = leaves(stats.select(F.col("node").alias("pid"), corner.alias("u"), F.lit(1).alias("w")), dims + 1, leaf or LEAF)
    boxes = tree.select("node", "up", "lo", "hi", F.col("cut").isNull().alias("is_leaf"))
    gap = lambda i: F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("u")[i] - side, F.col("u")[i] - F.col("hi")[i] - side)
    reached = F.sqrt(sum((gap(i) * gap(i) for i in range(dims + 1)), F.lit(0.0))) <= eps * (1 + 1e-6)
    asking, visits = placed.select("pid", "u", F.lit(0).cast("long").alias("up")), None
    while True:  # one round for each level of the tree
        below = stored(asking.join(boxes, "up").where(reached).select("pid", "u", "node", "is_leaf"))
        found = below.where("is_leaf").select("pid", "node")
        visits = found if visits is None else visits.unionByName(found)
        asking = below.where("not is_leaf").select("pid", "u", F.col("node").alias("up"))
        if asking.isEmpty():
            break
    box = stats.select(F.col("node").alias("pid"), F.col("lo"), F.col("hi"))
    lots = visits.groupBy("node").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("lots"))
    left = visits.join(lots, "node").join(box, "pid").select("node", F.pmod(F.xxhash64("pid"), F.col("lots")).cast("int").alias("lot"), F.col("pid").alias("node_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = placed.select("pid", "node").join(lots, "node").join(box, "pid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    right = right.select(F.col("node").alias("at"), "part", F.col("pid").alias("node_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = stored(left.groupBy("node", "lot").cogroup(right.groupBy("at", "part")).applyInPandas(near_boxes(eps), "node_a long, node_b long"))
    both = pairs.join(side_of(stats, "a"), "node_a").join(side_of(stats, "b"), "node_b")
    return both.where(F.col("cell_a")[0] == F.col("cell_b")[0])


def refined(points: DataFrame, open_pairs: DataFrame, side: float, dims: int, eps: float, levels: int = 10) -> DataFrame:
    """(node_a, node_b) of those pairs of core cells (cell_a, cell_b, node_a, node_b) that hold points within eps of each other.

    Both cells are halved again and again; parts that are too far apart go, and a pair goes once it is proven near. What
    is left in parts of a 1024th of a cell is compared point by point.
    """
    ids, links = ["node_a", "node_b"], None
    both = open_pairs.select(F.col("cell_a").alias("cell")).unionByName(open_pairs.select(F.col("cell_b").alias("cell"))).distinct()
    held = stored(points.join(both, "cell", "left_semi"))
    front = open_pairs.select(*ids, F.col("cell_a").alias("up_a"), F.col("cell_b").alias("up_b"))
    up = "cell"
    for level in range(1, levels + 1):
        part = F.concat(F.slice("cell", 1, 1), F.array(*[F.floor(F.col("u")[i] / (side / 2**level)) for i in range(dims)]))
        held = held.withColumn(f"part{level}", part)
        parts = stored(cell_stats(held, [up, f"part{level}"], dims).withColumnsRenamed({up: "up", f"part{level}": "part"}).drop("node"))
        tested = front.join(side_of(parts, "a"), "up_a").join(side_of(parts, "b"), "up_b").where(box_gap("a", "b", dims) <= eps)
        tested = stored(tested.select(*ids, "part_a", "part_b", surely_near("a", "b", dims, eps).alias("near")))
        found = tested.where("near").select(*ids).distinct()
        links = found if links is None else links.unionByName(found)
        front = stored(tested.where("not near").join(found, ids, "left_anti").select(*ids, F.col("part_a").alias("up_a"), F.col("part_b").alias("up_b")))
        up = f"part{level}"
        if front.isEmpty():
            return links
    one = held.select(F.col(up).alias("up_a"), F.col("u").alias("ua"))
    two = held.select(F.col(up).alias("up_b"), F.col("u").alias("ub"))
    last = front.join(one, "up_a").join(two, "up_b").where(apart(F.col("ua"), F.col("ub"), dims) <= eps).select(*ids).distinct()
    return links.unionByName(last)


#: Edges that one task joins up.
SMALL = 500_000


def joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(point_id, top) of all ends of the edges (a, b) of one task: union by the smaller id, paths halved."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for rows in batches:
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame({"point_id": list(above), "top": [top(x) for x in above]}, dtype="int64")


def connected(points: DataFrame, pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(point_id, region): the smallest id reachable.

    Every node joins its smallest neighbour, if that is smaller, and the edges left are those between what the nodes have
    become: at least half of the nodes with edges go in a round. Once no more than ``small`` edges are left, one task
    joins them up.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    labels = points.select("point_id", F.col("point_id").alias("region"))
    while edges.count() > small:
        least = stored(edges.groupBy(F.col("a").alias("point_id")).agg(F.min("b").alias("top")))
        at = lambda end: least.select(F.col("point_id").alias(end), F.col("top").alias(f"top_{end}"))  # noqa: B023, E731
        moved = edges.join(at("a"), "a").join(at("b"), "b", "left").select(F.col("top_a").alias("a"), F.coalesce("top_b", "b").alias("b")).where("a <> b")
        left = stored(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        discard(edges)
        edges = left
        labels = stored(labels.join(least.withColumnRenamed("point_id", "region"), "region", "left").select("point_id", F.coalesce("top", "region").alias("region")))
    tops = edges.coalesce(1).mapInPandas(joined_up, "point_id long, top long").withColumnRenamed("point_id", "region")
    return stored(labels.join(tops, "region", "left").select("point_id", F.coalesce("top", "region").alias("region")))


def dbscan(points: DataFrame, eps: float, min_samples: int = 2, by: Column | None = None) -> DataFrame:
    """(point_id, region). Cores link; a border point joins the region of its smallest core's; noise is a region of its own.

    Cells have side eps / sqrt(d). A cell with ``min_samples`` points is one core node, named by its smallest id; the
    points of the other cells, fewer than ``min_samples`` in each, are compared one by one with the points of the cells
    around, and only counts of these go on. Core cells link where facing points prove it, or else by halving, which is
    asked only of cells that other links have not joined. A cell with most points is split by adaptive execution, as the
    points meet their neighbours by an equi-join on cells. Points with different values of ``by`` (a LONG) never meet.
    """
    ready(points.sparkSession)
    dims = points.select(F.max(F.size("u")).alias("d")).first()["d"] or 1
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    group = (F.lit(0) if by is None else by).cast("long")
    placed = stored(points.select("point_id", "u", F.array(group, *[F.floor(F.col("u")[i] / side) for i in range(dims)]).alias("cell")))
    stats = stored(cell_stats(placed, ["cell"], dims))
    heavy = F.col("n") >= min_samples
    pairs = neighbouring_cells(stats, dims, eps)
    heavy_a, heavy_b = F.col("n_a") >= min_samples, F.col("n_b") >= min_samples
    small = ["cell_a", "cell_b", "node_a", "node_b"]
    near = stored(pairs.select(*small, heavy_a.alias("heavy_a"), heavy_b.alias("heavy_b"), F.when(heavy_a & heavy_b, surely_near("a", "b", dims, eps)).alias("linked")))

    # points of light cells against all around them
    out = near.where(~F.col("heavy_a")).select(F.col("cell_a").alias("own"), F.col("cell_b").alias("cell"), F.col("node_b").alias("node"), F.col("heavy_b").alias("heavy"))
    back = near.where(~F.col("heavy_b")).select(F.col("cell_b").alias("own"), F.col("cell_a").alias("cell"), F.col("node_a").alias("node"), F.col("heavy_a").alias("heavy"))
    self = stats.where(~heavy & (F.col("n") > 1)).select(F.col("cell").alias("own"), "cell", "node", F.lit(False).alias("heavy"))
    asked = out.unionByName(back).unionByName(self).join(placed.select(F.col("cell").alias("own"), F.col("point_id").alias("p"), F.col("u").alias("up")), "own").drop("own")
    met = asked.join(placed.select("cell", F.col("point_id").alias("q"), "u"), "cell").where((F.col("p") != F.col("q")) & (apart(F.col("up"), F.col("u"), dims) <= eps))
    touch = stored(met.groupBy("p", F.when(F.col("heavy"), F.col("node")).otherwise(F.col("q")).alias("q"), "heavy").agg(F.count("*").alias("n")))
    cores = stored(touch.groupBy(F.col("p").alias("point_id")).agg(F.sum("n").alias("n")).where(F.col("n") + 1 >= min_samples).select("point_id"))

    nodes = stats.where(heavy).select(F.col("node").alias("point_id")).unionByName(cores)
    ends = touch.join(cores.withColumnRenamed("point_id", "p"), "p", "left_semi").join(nodes.withColumnRenamed("point_id", "q"), "q", "left_semi").select(F.col("p").alias("a"), F.col("q").alias("b"))
    labels = connected(nodes, ends.unionByName(near.where("linked").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))))
    of = lambda name: labels.select(F.col("point_id").alias(f"node_{name}"), F.col("region").alias(f"region_{name}"))
    doubtful = stored(near.where("not linked").join(of("a"), "node_a").join(of("b"), "node_b").where("region_a <> region_b"))
    if not doubtful.isEmpty():
        more = refined(placed, doubtful.select(*small), side, dims, eps).join(of("a"), "node_a").join(of("b"), "node_b")
        top = connected(labels.select(F.col("region").alias("point_id")).distinct(), more.select(F.col("region_a").alias("a"), F.col("region_b").alias("b")))
        labels = stored(labels.join(top.select(F.col("point_id").alias("region"), F.col("region").alias("top")), "region").select("point_id", F.col("top").alias("region")))

    cells = stats.where(heavy).select("cell", F.col("node").alias("point_id")).join(labels, "point_id").select("cell", F.col("region").alias("of_cell"))
    border = touch.join(labels.select(F.col("point_id").alias("q"), "region"), "q").groupBy(F.col("p").alias("point_id")).agg(F.min("region").alias("border"))
    named = placed.select("point_id", "cell").join(cells, "cell", "left").join(labels, "point_id", "left").join(border, "point_id", "left")
    return named.select("point_id", F.coalesce("of_cell", "region", "border", "point_id").alias("region"))


#: Points of a leaf at most; children of a node; visitors that meet a leaf's points at a time.
LEAF, FAN, VISITORS = 512, 8, 4096


def leaves(cloud: DataFrame, dims: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The points (with ``node``, their leaf) and the tree (node, up, n, lo, hi, cut): every node above ``size`` points is
    cut on its widest axis at quantiles of a sketch. Points must be distinct, so that any node can be cut."""
    u = [F.col("u")[i] for i in range(dims)]
    shares = [(k + 1) / FAN for k in range(FAN - 1)]
    placed, tree = cloud.withColumn("node", F.lit(1).cast("long")), None
    while True:
        aggs = [F.count("*").alias("n"), F.array(*map(F.min, u)).alias("lo"), F.array(*map(F.max, u)).alias("hi"), F.array(*[F.percentile_approx(x, shares, 1000) for x in u]).alias("cuts")]
        made = placed if tree is None else placed.where("fresh").drop("fresh")
        wide = F.zip_with("hi", "lo", lambda a, b: a - b)
        axis = (F.array_position(wide, F.array_max(wide)) - 1).cast("int")
        level = made.groupBy("node").agg(*aggs).withColumn("axis", axis)
        inner = F.array_distinct(F.filter(F.get("cuts", F.col("axis")), lambda c: c < F.get("hi", F.col("axis"))))
        inner = F.when(F.size(inner) > 0, inner).otherwise(F.array(F.get("lo", F.col("axis"))))
        level = stored(level.select("node", F.floor(F.col("node") / FAN).alias("up"), "n", "lo", "hi", "axis", F.when(F.col("n") > size, inner).alias("cut")))
        tree = level if tree is None else tree.unionByName(level)
        if level.where("cut is not null").isEmpty():
            return placed.drop("fresh"), tree
        child = F.col("node") * FAN + F.size(F.filter("cut", lambda c: c < F.get("u", F.col("axis"))))
        cut = level.where("cut is not null").select("node", "axis", "cut")
        joined = placed.join(cut, "node", "left")
        placed = stored(joined.select("pid", "u", "w", F.when(F.col("cut").isNull(), F.col("node")).otherwise(child).alias("node"), F.col("cut").isNotNull().alias("fresh")))


def nearest_of_leaf(k: int):
    """For cogroups of visitors (pid, u) and one leaf's points (other, v, w): each visitor's k smallest distances, w times each."""

    def run(visitors: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or points.empty:
            return pd.DataFrame({"pid": [], "best": []})
        x, y, w = np.stack(visitors["u"]), np.stack(points["v"]), points["w"].to_numpy()
        mine, theirs, out = visitors["pid"].to_numpy(), points["other"].to_numpy(), []
        few = min(k + 1, len(y))
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            far = np.sqrt(sum((part[:, i, None] - y[None, :, i]) ** 2 for i in range(x.shape[1])))
            first = np.argpartition(far, few - 1, axis=1)[:, :few]
            first = np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, 1), axis=1), 1)
            far = np.pad(np.take_along_axis(far, first, 1), ((0, 0), (0, 1)), constant_values=np.inf)
            times = np.cumsum(w[first] - (theirs[first] == mine[at : at + 512, None]), axis=1)  # a point is not its own neighbour
            out.append(np.stack([np.take_along_axis(far, (times < j).sum(axis=1)[:, None], 1)[:, 0] for j in range(1, k + 1)], 1))
        return pd.DataFrame({"pid": mine, "best": list(np.concatenate(out))})

    return run


def visited(visits: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(pid, best) for each visit (pid, u, node) of a leaf; a leaf with many visitors is copied for each lot of them."""
    lots = visits.groupBy("node").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("lots"))
    left = visits.join(lots, "node").withColumn("lot", F.pmod(F.xxhash64("pid"), F.col("lots")).cast("int"))
    right = placed.join(lots, "node").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    there = right.select(F.col("node").alias("at"), F.col("lot").alias("part"), F.col("pid").alias("other"), F.col("u").alias("v"), F.col("w").alias("w"))
    groups = left.select("node", "lot", "pid", "u").groupBy("node", "lot").cogroup(there.groupBy("at", "part"))
    return groups.applyInPandas(nearest_of_leaf(k), "pid long, best array<double>")


def neighbour_distances(points: DataFrame, dims: int, k: int = 2, leaf: int = LEAF) -> DataFrame:
    """(point_id, dist): the distance of each point to its k-th nearest other point; null where there are not so many.

    Equal points count by their number. Points are cut into leaves of at most ``leaf``. A point's k-th distance within
    its leaf, or its reach over the node above, bounds the search: it visits the other leaves whose boxes come nearer,
    found down the tree by equi-joins. Each visit brings the k smallest distances, and these merge.
    """
    ready(points.sparkSession)
    cloud = stored(points.select("point_id", "u"))
    if cloud.limit(k + 1).count() <= k:
        return cloud.select("point_id", F.lit(None).cast("double").alias("dist"))
    distinct = stored(cloud.groupBy("u").agg(F.count("*").alias("w")).withColumn("pid", F.monotonically_increasing_id()))
    placed, tree = leaves(distinct.select("pid", "u", "w"), dims, leaf)
    first = stored(visited(placed.select("pid", "u", "node"), placed, k))
    boxes = tree.select("node", "up", "lo", "hi", F.col("cut").isNull().alias("is_leaf"))
    above = boxes.select(F.col("node").alias("up"), F.col("lo").alias("lo_up"), F.col("hi").alias("hi_up"))
    reach = F.sqrt(sum((F.greatest(F.pow(F.col("hi_up")[i] - F.col("u")[i], 2.0), F.pow(F.col("u")[i] - F.col("lo_up")[i], 2.0)) for i in range(dims)), F.lit(0.0)))
    started = placed.withColumn("up", F.floor(F.col("node") / FAN)).join(above, "up", "left").join(first, "pid")
    radius = F.least(F.col("best")[k - 1], F.coalesce(reach, F.lit(float("inf"))))
    asking = stored(started.select("pid", "u", F.col("node").alias("own"), radius.alias("r"), F.lit(1).cast("long").alias("up")))
    gap = F.sqrt(sum((F.pow(F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("u")[i], F.col("u")[i] - F.col("hi")[i]), 2.0) for i in range(dims)), F.lit(0.0)))
    visits = None
    while True:  # one round for each level of the tree
        below = stored(asking.join(boxes, "up").where((F.col("node") != F.col("own")) & (gap <= F.col("r"))).select("pid", "u", "own", "r", "node", "is_leaf"))
        if below.isEmpty():
            break
        found = below.where("is_leaf").select("pid", "u", "node")
        visits = found if visits is None else visits.unionByName(found)
        asking = below.where("not is_leaf").select("pid", "u", "own", "r", F.col("node").alias("up"))
    best = first if visits is None else first.unionByName(visited(visits, placed, k))
    merged = best.groupBy("pid").agg(F.flatten(F.collect_list("best")).alias("best")).select("pid", F.array_sort("best")[k - 1].alias("dist"))
    return stored(cloud.join(distinct.join(merged, "pid").select("u", "dist"), "u").select("point_id", "dist"))
