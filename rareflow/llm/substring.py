"""Repeats of ``window`` words or more across documents, by prefix-partitioned suffix trees.

Shipping every suffix of every text would multiply the corpus by the window length, so only suffixes that can matter
are shipped, and nothing is lost by it:

1. The texts are compressed and get row keys once. Every window of ``window`` words has an anchor: the word of its smallest ``GRAM``-word hash. Equal windows have
   equal anchors, so a window repeated in another document has an anchor gram that two documents share. One pass
   collects each document's anchor grams; the grams with two documents or more are the shared ones.
2. A second pass over the documents that hold a shared gram emits, for each of its places, the suffix that starts at
   the anchor together with the words before it that its windows need. Equal suffixes collapse to one row with the
   smallest document id, before and after the shuffle.
3. Suffixes are split by prefix into groups that fit in memory. At first the prefix is the anchor gram, and a group
   stands for the windows that start 0 to ``window - GRAM`` words before it. A group of more than ``GROUP`` different
   suffixes is halved by window start: the near half agrees in more words from the anchor on, the far half in more
   words before it, so each half has a longer prefix, and is split again until it fits. A group for a single window
   start has the whole window as its prefix: it is one deep node. In all other groups the suffixes are sorted, their
   common prefixes give the internal nodes, and nodes as deep as the window asks, split by the words before the
   anchor, are the repeats; each takes the smallest id.
4. A last pass removes the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, keep, signed, text_or_empty, texts, word_ids

GRAM, GROUP = 16, 256


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its gram hash, its place, and the first and last window that it is the anchor of."""
    if len(words) < window:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty
    grams = gram_hashes(word_ids(words), GRAM)
    at = sliding_window_view(grams, window - GRAM + 1).argmin(axis=1) + np.arange(len(words) - window + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return grams[at[first]], at[first], first, last


def anchor_grams(bodies: DataFrame, window: int) -> DataFrame:
    """Distinct (gram, row, doc_id) from (row, doc_id, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [np.unique(anchors(unpress.decompress(t).split(), window)[0]) for t in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            grams = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), batch.column(0).take(row), batch.column(1).take(row)], names=["gram", "row", "doc_id"])

    return bodies.mapInArrow(run, "gram long, row long, doc_id long")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text, for the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t) for t in texts(batch)], pa.binary())], names=["doc_id", "body"])

    return docs.mapInArrow(run, "doc_id long, body binary")


def shared_suffixes(bodies: DataFrame, window: int) -> DataFrame:
    """For each place of a shared gram in (row, doc_id, body, grams): row, doc_id, gram, place, words before the anchor, windows, a fingerprint, the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            row, out = [], [[] for _ in range(7)]
            for i, (body, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                words = unpress.decompress(body).split()
                gram, place, first, last = anchors(words, window)
                for k in np.flatnonzero(np.isin(signed(gram), wanted.values.to_numpy())):
                    p, lo, hi = int(place[k]), int(first[k]), int(last[k])
                    text = b" ".join(words[lo : hi + window])
                    mark = xxhash.xxh3_128_intdigest(text, seed=p - lo)
                    row.append(i)
                    for column, value in zip(out, (int(gram[k].view(np.int64)), p, p - lo, hi - lo + 1, (mark >> 64) - (1 << 63), (mark & ((1 << 64) - 1)) - (1 << 63), text), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
                names=["row", "doc_id", "gram", "place", "before", "windows", "mark_a", "mark_b", "words"],
            )

    return bodies.mapInArrow(run, "row long, doc_id long, gram long, place long, before int, windows int, mark_a long, mark_b long, words binary")


def common_prefix(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def subtree(suffixes: list[tuple[list[bytes], list[bytes], int, int]], window: int, lo: int, hi: int) -> list[list[int]]:
    """Smallest id of every window of every suffix in one group; windows that start lo to hi words before the anchor.

    A suffix is (words from the anchor on, words before it, number of windows, smallest id). Sorted suffixes and the
    common prefixes of neighbours are the tree: a node of depth d is a maximal run of neighbours with d common words.
    The window that starts ``b`` words before the anchor needs depth window - b and equal last b words before.
    """
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i][0])
    depth = [0] + [common_prefix(suffixes[a][0], suffixes[b][0]) for a, b in zip(order, order[1:])]
    best = [[doc] * n for _, _, n, doc in suffixes]
    for b in range(lo, min(hi, max(len(s[1]) for s in suffixes)) + 1):
        node: dict[tuple, list[int]] = {}
        for at in range(len(order) + 1):
            if at == len(order) or depth[at] < window - b:  # the node above ends here
                for same in node.values():
                    if len(same) > 1:
                        least = min(suffixes[i][3] for i in same)
                        for i in same:
                            best[i][len(suffixes[i][1]) - b] = least
                node = {}
            if at < len(order):
                i = order[at]
                before, n = suffixes[i][1], suffixes[i][2]
                if len(before) - n < b <= len(before):
                    node.setdefault(tuple(before[len(before) - b :]), []).append(i)
    return best


#: A suffix in a group: its group (prefix and window starts), itself, and the smallest document that has it.
MEMBER = "prefix_a long, prefix_b long, lo int, hi int, before int, windows int, mark_a long, mark_b long, words binary, least_doc long"
KEY = ["prefix_a", "prefix_b", "lo", "hi"]


def halves(members: DataFrame, window: int) -> DataFrame:
    """Members of overfull groups, in a group for each half of the window starts that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, made = [], [[] for _ in range(4)]
            lows, highs, befores, windows, bodies = (batch.column(i).to_pylist() for i in (2, 3, 4, 5, 8))
            for i, (lo, hi, before, n, body) in enumerate(zip(lows, highs, befores, windows, bodies, strict=True)):
                words, middle = body.split(), (lo + hi) // 2
                for first, last in ((lo, middle), (middle + 1, hi)):
                    if before - n < last and first <= before:
                        mark = xxhash.xxh3_128_intdigest(b" ".join(words[before - first : before + window - last]))
                        row.append(i)
                        for column, value in zip(made, ((mark >> 64) - (1 << 63), (mark & ((1 << 64) - 1)) - (1 << 63), first, last), strict=True):
                            column.append(value)
            take = pa.array(row, pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(made, kinds, strict=True)), *(c.take(take) for c in batch.columns[4:])], names=batch.schema.names)

    return members.mapInArrow(run, MEMBER)


def trees(groups: DataFrame, window: int) -> DataFrame:
    """mark_a, mark_b, start, least: the smallest id of each window from ``start`` on, for members that come sorted by group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["mark_a", "mark_b", "start", "least"])
            out.clear()
            return made

        for (_, _, lo, hi), group in groupby(rows(batches), key=lambda r: r[:4]):
            members, suffixes = list(group), []
            for _, _, _, _, before, windows, _, _, text, least in members:
                words = text.split()
                suffixes.append((words[before:], words[:before], windows, least))
            for r, least in zip(members, subtree(suffixes, window, lo, hi), strict=True):
                out.append((r[6], r[7], least))
            if len(out) >= 5000:
                yield flush()
        yield flush()

    return groups.mapInArrow(run, "mark_a long, mark_b long, start int, least array<long>")


def smallest_ids(suffixes: DataFrame, window: int, group: int) -> DataFrame:
    """mark_a, mark_b, start, least for all windows of all different suffixes, through groups of ``group`` members at most.

    Each round splits the overfull groups only; after log2(window - GRAM) rounds none can be split any further.
    """
    found: DataFrame | None = None
    members = suffixes
    while True:
        full = keep(members.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > group).select(*KEY))
        single = F.col("lo") == F.col("hi")
        fitting = members.join(full.where(~single), KEY, "left_anti").where(~single)
        parts = [trees(fitting.select(*members.columns).repartition(*KEY).sortWithinPartitions(*KEY), window)]
        # one window start: the group is one node, however many suffixes pass through it
        nodes = members.where(single).groupBy(*KEY).agg(F.min("least_doc").alias("node"))
        parts.append(members.where(single).join(nodes, KEY).select("mark_a", "mark_b", (F.col("before") - F.col("lo")).alias("start"), F.array("node").alias("least")))
        for part in parts:
            found = part if found is None else found.unionByName(part)
        found = keep(found)
        if not full.where(~single).limit(1).count():
            return found
        members = keep(halves(members.join(full.where(~single), KEY, "left_semi").select(*members.columns), window))


def removed(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text from (doc_id, body, cuts); cuts: structs of a first window and flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for body, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = unpress.decompress(body).split()
                cover = np.zeros(len(words) + 1, np.int64)
                for cut in cuts or ():
                    for k in cut["starts"]:
                        cover[k] += 1
                        cover[k + window] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                n_words.append(len(words)), n_removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not cuts else [w for w, g in zip(words, gone, strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def drop_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    Removes each word covered by a window of ``window`` words that also starts in a document with a smaller id; all
    windows are judged on the input. Null text has no words; shorter texts have no windows; a row with a null id is
    neither compared nor cut; rows that repeat an id each give a row and do not cut each other, whatever their texts; an
    empty table gives an empty result; other columns are ignored. ``group`` bounds the suffixes that a task sorts at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    bodies = keep(packed(rows).withColumn("row", F.monotonically_increasing_id())).select("row", "doc_id", "body")
    grams = keep(anchor_grams(bodies.where("doc_id is not null"), window))
    shared = keep(grams.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("gram"))
    wanted = keep(grams.join(shared, "gram").groupBy("row").agg(F.collect_set("gram").alias("grams")))
    places = keep(shared_suffixes(bodies.join(wanted, "row").select("row", "doc_id", "body", "grams"), window))

    different = places.groupBy("gram", "mark_a", "mark_b").agg(F.min("doc_id").alias("least_doc"), F.first("before").alias("before"), F.first("windows").alias("windows"), F.first("words").alias("words"))
    whole = [F.col("gram").alias("prefix_a"), F.lit(0).cast("long").alias("prefix_b"), F.lit(0).alias("lo"), F.lit(window - GRAM).alias("hi")]
    found = smallest_ids(keep(different.select(*whole, "before", "windows", "mark_a", "mark_b", "words", "least_doc")), window, group)

    first = F.col("place") - F.col("before")
    cuts = (
        places.select("row", "doc_id", "mark_a", "mark_b", first.alias("first")).join(found, ["mark_a", "mark_b"])
        .select("row", F.expr("filter(transform(least, (x, i) -> if(x < doc_id, first + start + i, null)), x -> x is not null)").alias("starts"))
        .where(F.size("starts") > 0)
        .groupBy("row").agg(F.collect_list(F.struct("starts")).alias("cuts"))
    )
    return removed(bodies.join(keep(cuts), "row", "left").select("doc_id", "body", "cuts"), window)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
