"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

1. One narrow pass gives each row a key, a fingerprint of its shingle set and a sketch cut into bands, and keeps the
   compressed text beside them.
2. Rows with equal sets collapse to one representative; only these go on.
3. Bands with several representatives are buckets; buckets with the same members count once. Every member is paired
   with the bucket's best-connected member, then, where a bucket still mixes components, with the best-connected one
   outside that member's component, and so on for a few rounds. Pairs are verified on the full sets, links become
   components. A member's text travels once a round; a centre's only to where its members are.
4. Buckets that still mix components are compared whole, inside tasks, a pair of bounded blocks at a time. Only links
   that join components leave a task, never all pairs, and no pair of a bucket goes untested.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, keep, mix, signed, text_or_empty, texts, word_ids

COORDINATES, BANDS = 128, 32
#: Star rounds before what is left is compared whole, and shingles in a block of that (8 bytes each).
ROUNDS, BLOCK = 3, 400_000
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of the words of a text, A-Z lowered; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_ids(words), min(width, len(words))))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen, Thorup): one value for each coordinate.

    Round r throws every element into a random coordinate with value r + hash; the rounds from COORDINATES on fill
    coordinate r - COORDINATES for certain. A coordinate keeps its smallest value, so rounds stop once all are filled.
    """
    t, n = COORDINATES, len(elements)
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    r = 0
    while r < 2 * t:
        rounds = np.arange(r, min(2 * t, r + max(1, 1024 // n)))
        h = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        bins = (h >> np.uint64(57)).astype(np.int64)
        bins[rounds >= t] = (rounds[rounds >= t] - t)[:, None]
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(50)) | (h & np.uint64((1 << 50) - 1))
        np.minimum.at(out, bins.ravel(), value.ravel())
        r = int(rounds[-1]) + 1
        if r <= t and out.max() < np.iinfo(np.uint64).max or r > t and (out >> np.uint64(50)).max() < t + t:
            break
    return out


def bands(values: np.ndarray) -> np.ndarray:
    rows = COORDINATES // BANDS
    with np.errstate(over="ignore"):
        grouped = values.reshape(BANDS, rows) * _SEEDS[:rows][None, :]
        return mix(grouped.sum(axis=1, dtype=np.uint64) ^ _SEEDS[8 : 8 + BANDS])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's fingerprint, the bands, and the lowered text, compressed (null where
    the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            size, first, second, band, body = [], [], [], [], []
            for text in texts(batch):
                s = shingles(text, width)
                size.append(len(s))
                if not len(s):
                    first.append(None), second.append(None), band.append(None), body.append(None)
                    continue
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                first.append((digest >> 64) - (1 << 63))
                second.append((digest & ((1 << 64) - 1)) - (1 << 63))
                band.append(signed(bands(sketch(s))))
                body.append(press.compress(text.lower()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(body, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "body"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, body binary")


def verified(pairs: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; many a may share one b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, known = zstandard.ZstdDecompressor(), {}

        def set_of(doc: int, body: bytes) -> np.ndarray:
            if doc not in known:
                if len(known) >= 64:
                    known.clear()
                known[doc] = shingles(unpress.decompress(body), width)
            return known[doc]

        for batch in batches:
            a, b, body_a, body_b = (batch.column(i).to_pylist() for i in range(4))
            linked = []
            for i in range(len(a)):
                x, y = set_of(a[i], body_a[i]), set_of(b[i], body_b[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    left = bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "body_a", "body_b")
    return rows.mapInArrow(run, "a long, b long, linked boolean").where("linked").select("a", "b")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable label for each (doc_id, comp), following links (a, b) until nothing changes.

    Each round takes the smallest label among neighbours and then the label of that label, so paths halve.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    touched = keep(labels.join(both.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    start = touched
    while True:
        near = both.join(touched.select(F.col("doc_id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("near"))
        # a label is itself a document; what its document has come to be called is a better label still
        hop = keep(touched.join(near, "doc_id").select("doc_id", "comp", F.least("comp", "near").alias("best")))
        top = hop.groupBy(F.col("comp").alias("of")).agg(F.min("best").alias("top"))
        new = keep(hop.join(top, hop["best"] == top["of"], "left").select("doc_id", F.least("best", F.coalesce("top", "best")).alias("comp"), F.col("comp").alias("was")))
        moved = new.where(F.col("comp") < F.col("was")).limit(1).count()
        touched = new.select("doc_id", "comp")
        if not moved:
            break
    # members of a component that no link touched follow their former label
    renamed = keep(start.select("doc_id", F.col("comp").alias("of")).join(touched, "doc_id").groupBy("of").agg(F.min("comp").alias("to")))
    return labels.join(renamed, labels["comp"] == renamed["of"], "left").select("doc_id", F.coalesce("to", "comp").alias("comp"))


def candidate_members(reps: DataFrame) -> DataFrame:
    """(key, doc_id, size) of the buckets with two representatives or more; buckets with the same members count once."""
    all_members = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = all_members.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("mark"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("size > 1")
    shared = keep(buckets.groupBy("size", "mark", "least", "most").agg(F.min("key").alias("key")).select("key", "size"))
    return keep(all_members.join(shared, "key").select("key", "doc_id", "size"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: one product of the incidence matrix, taken over the shingles that two sets or more
    hold, a block of columns at a time."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], column[times[column] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    both, wide = np.zeros((m, m), np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, (at, at + wide))
        held = np.zeros((m, wide), np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        both += held @ held.T
    return both.astype(np.int64)


def linked_in(sets: list[np.ndarray], comps: list[int], percent: int, sides: list[int] | None = None, step: int = 512) -> list[tuple[int, int]]:
    """Links (places) that join all components which some pair of these sets links: a forest, not every linked pair.

    With ``sides`` (0 or 1), only pairs across the sides count. At most 2 * ``step`` sets are compared at a time.
    """
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    if sides is None:
        chunks = [range(at, min(at + step, len(sets))) for at in range(0, len(sets), step)]
        turns = [(x, y) for k, x in enumerate(chunks) for y in chunks[k:]]
    else:
        first, second = ([k for k, side in enumerate(sides) if side == want] for want in (0, 1))
        turns = [(first[x : x + step], second[y : y + step]) for x in range(0, len(first), step) for y in range(0, len(second), step)]
    sizes, found = np.array([len(x) for x in sets]), []
    for x, y in turns:
        here = list(dict.fromkeys([*x, *y]))
        comp = np.array([top(comps[k]) for k in here])
        if (comp == comp[0]).all():
            continue
        both, size = intersections([sets[k] for k in here]), sizes[here]
        enough = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :])
        if sides is not None:
            enough[: len(x), : len(x)] = enough[len(x) :, len(x) :] = False
        for i, j in np.argwhere(np.triu(enough)).tolist():
            p, q = top(comps[here[i]]), top(comps[here[j]])
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((here[i], here[j]))
    return found


def compared(members: DataFrame, bodies: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) inside the buckets of ``members`` (key, doc_id, comp, n_shingles), all pairs compared in tasks.

    A bucket of more than ``block`` shingles is dealt out as pairs of blocks, so a task holds about two blocks.
    """
    parts = members.groupBy("key").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")
    dealt = members.join(parts, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("key", i.alias("i"), j.alias("j"), "doc_id", "comp", F.when(i < j, (F.col("own") == j).cast("int")).alias("side"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        a, b = [], []
        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            docs = [r[3:] for r in group]
            if len({comp for _, comp, _, _ in docs}) > 1:
                sets = [shingles(unpress.decompress(body), width) for *_, body in docs]
                sides = [side for _, _, side, _ in docs]
                for x, y in linked_in(sets, [comp for _, comp, _, _ in docs], percent, None if None in sides else sides):
                    a.append(docs[x][0])
                    b.append(docs[y][0])
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = dealt.join(bodies, "doc_id").select("key", "i", "j", "doc_id", "comp", "side", "body")
    return held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct ``width``-word shingles of its lowered text. Documents with Jaccard similarity
    of ``percent`` / 100 or more are linked (candidates: 32 bands of 4 coordinates, which miss a pair at 0.8 with
    probability 5e-8; links: exact). ``component_id`` is the smallest id reachable and ``kept`` marks it. Null or
    empty texts have no shingles and stay alone; a null id gets a null component and is kept; rows that repeat an id
    are each compared with their own text, and two of one component give the same answer; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed_rows = keep(signatures(rows, width).withColumn("row", F.monotonically_increasing_id()))
    full = signed_rows.where("set_a is not null and doc_id is not null")
    same = keep(full.groupBy("set_a", "set_b").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")))
    # from here on, a representative's row key stands for it
    reps = full.join(same.select(F.col("rep").alias("row")), "row", "left_semi")
    members = candidate_members(reps.select(F.col("row").alias("doc_id"), "bands"))
    needed = keep(members.groupBy("doc_id").agg(F.sum("size").alias("degree")))
    bodies = keep(full.select(F.col("row").alias("doc_id"), "n_shingles", "body").join(needed.select("doc_id"), "doc_id", "left_semi"))
    members = keep(members.join(needed, "doc_id").join(bodies.select("doc_id", "n_shingles"), "doc_id").select("key", "doc_id", "n_shingles", "size", "degree"))
    bodies = bodies.select("doc_id", "body")

    labels = needed.select("doc_id", F.col("doc_id").alias("comp"))
    best = F.struct("degree", -F.col("doc_id"))
    centres = keep(members.groupBy("key").agg(F.max_by("doc_id", best).alias("centre")))
    pairs = members.join(centres, "key").where("doc_id <> centre")
    mixed = None
    for turn in range(rounds):
        tried = keep(pairs.select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct())
        links = keep(verified(tried, bodies, width, percent))
        if links.limit(1).count():
            labels = keep(components(labels, links))
        at = keep(members.where("size > 2").join(labels, "doc_id"))
        mixed = keep(at.join(at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "key"))
        if turn + 1 == rounds or not mixed.limit(1).count():
            break
        # the next centre: the best-connected member outside the components of the centres so far
        done = keep(centres.join(labels.select(F.col("doc_id").alias("centre"), "comp"), "centre").select("key", "comp"))
        fresh = mixed.join(done, ["key", "comp"], "left_anti")
        centres = keep(fresh.groupBy("key").agg(F.max_by("doc_id", best).alias("centre"), F.max_by("comp", best).alias("of")))
        pairs = mixed.join(centres, "key").where("comp <> of")
    links = keep(compared(mixed, bodies, width, percent, block))
    if links.limit(1).count():
        labels = keep(components(labels, links))

    comps = keep(same.join(labels.select(F.col("doc_id").alias("rep"), "comp"), "rep", "left").select("set_a", "set_b", F.coalesce("comp", "rep").alias("comp"), "least"))
    named = keep(comps.join(comps.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("set_a", "set_b", "component"))
    return (
        signed_rows.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
