"""Hilbert-curve sharding with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, every row gets its index on the Hilbert curve through
those cells, rows are sorted by the index, and the sorted run is cut into shards whose row counts differ by one at
most. Neighbouring cells share a shard, so the min/max statistics of each shard's files are narrow in every dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep


def hilbert_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each (state, corner): the corner's place on the curve, and the state inside it.

    A state is an entry corner and a direction; both follow from the Gray code (C. Hamilton's formulation).
    """
    corners, mask = 1 << dims, (1 << dims) - 1

    def turn(v: int, k: int) -> int:
        k %= dims
        return ((v >> k) | (v << (dims - k))) & mask

    def gray(v: int) -> int:
        return v ^ (v >> 1)

    order = {gray(w): w for w in range(corners)}

    def entry(w: int) -> int:
        return gray(2 * ((w - 1) // 2)) if w else 0

    def axis(w: int) -> int:
        w = w - 1 if w % 2 == 0 else w
        return 0 if w <= 0 else ((w ^ (w + 1)).bit_length() - 1) % dims

    place, after = [], []
    for state in range(dims * corners):
        d, e = divmod(state, corners)
        for corner in range(corners):
            w = order[turn(corner ^ e, d + 1)]
            place.append(w)
            new_e = e ^ turn(entry(w), -(d + 1))
            new_d = (d + axis(w) + 1) % dims
            after.append(new_d * corners + new_e)
    return place, after


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Index on the curve of integer coordinates in [0, 2**bits)."""
    dims = len(coords)
    corners = 1 << dims
    place, after = (F.lit(x) for x in hilbert_tables(dims))

    def step(acc: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)) * F.lit(1 << j) for j, c in enumerate(coords)), F.lit(0))
        at = acc["state"] * F.lit(corners) + corner
        return F.struct(
            (acc["h"] * F.lit(corners) + F.element_at(place, at + F.lit(1))).cast("long").alias("h"),
            F.element_at(after, at + F.lit(1)).cast("int").alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(F.lit(list(range(bits - 1, -1, -1))), start, step)["h"]


def _levels(docs: DataFrame, numeric: list[str], categorical: list[str], bits: int) -> list[Column]:
    """Numbers to equal-depth levels (edges from one approximate-percentile pass), strings to a hash level; null to 0."""
    n = 1 << bits
    shares = [i / n for i in range(1, n)]
    edges = docs.agg(*[F.percentile_approx(F.col(c), shares, 10_000).alias(c) for c in numeric]).first() if numeric else None
    levels = []
    for c in numeric:
        above = [F.when(F.col(c) >= F.lit(e), 1).otherwise(0) for e in (edges[c] or [])]
        levels.append(sum(above, F.lit(0)))
    for c in categorical:
        levels.append(F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")))
    return levels


def hilbert_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   numeric: tuple[str, ...] = ("n_chars", "doc_id"), categorical: tuple[str, ...] = ("lang", "source"),
                   bits: int = 4) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, hilbert.

    Law ``rows``: the row counts of shards differ by one at most; ``slot`` numbers a shard's rows from 0 along the
    curve. Null text counts as empty, null metadata as the lowest level, a null id sorts first. Rows with equal keys
    are ordered by their text checksum and then by scan order, so repeated rows each keep a place. Fewer rows than
    shards leave the last shards empty; an empty input gives no rows. Other columns are ignored.

    The only global steps are one approximate-percentile pass over the metadata, one range sort of narrow rows, and
    one count per sorted partition (as many numbers as partitions reach the driver).
    """
    placed = _placed(docs, n_shards, id_col, text_col, numeric, categorical, bits, [])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def _placed(docs: DataFrame, n_shards: int, id_col: str, text_col: str, numeric: tuple[str, ...], categorical: tuple[str, ...], bits: int, carried: list[Column]) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard, slot and the carried columns, in curve order inside each partition."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_index(_levels(docs, list(numeric), list(categorical), bits), bits).alias("hilbert"),
        F.monotonically_increasing_id().alias("__scan"),
        *carried,
    )
    keys = ["hilbert", "doc_id", "text_crc32", "__scan"]
    run = keep(narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__scan"))
    # monotonically_increasing_id: the partition in the high bits, the place in the sorted partition in the low 33
    part = F.shiftright("__at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in run.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    rank = F.element_at(F.lit(before or [0]).cast("array<bigint>"), part + F.lit(1)) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    n, s = F.lit(max(total, 1)).cast("long"), F.lit(n_shards).cast("long")
    return (
        run.withColumn("__rank", rank)
        .withColumn("shard", F.call_function("div", F.col("__rank") * s, n).cast("int"))
        .withColumn("slot", F.col("__rank") - F.call_function("div", F.col("shard") * n + s - F.lit(1), s))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                 numeric: tuple[str, ...] = ("n_chars", "doc_id"), categorical: tuple[str, ...] = ("lang", "source"), bits: int = 4) -> str:
    """Write whole rows into one folder per shard, as ``hilbert_shards`` places them, in curve order inside each.

    Rows travel through the range sort, so every row is written once: with a null id, repeated or not. All columns keep
    their names; the folders' column is named ``shard``, with underscores in front where the table has one of that name.
    Returns that name. An empty table writes no folder.
    """
    folder = "shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    placed = _placed(docs, n_shards, id_col, text_col, numeric, categorical, bits, [F.struct(*[F.col(c) for c in docs.columns]).alias("__row")])
    rows = placed.sortWithinPartitions("shard", "slot").select(*[F.col("__row")[c].alias(c) for c in docs.columns], F.col("shard").alias(folder))
    rows.write.partitionBy(folder).parquet(path)
    return folder
