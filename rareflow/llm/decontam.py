"""Benchmark decontamination by spaced seeds.

A seed mask looks at some of the positions under it and ignores the others, so a substituted word under an ignored
position does no harm.

1. The benchmark's seeds, under every mask, are a Spark table (hash, item, place).
2. One narrow pass hashes every position of every text under each mask. A bitmap of fixed size, made from the
   benchmark's seeds, rejects nearly all of them; texts without any hit are done.
3. Hits are joined to the seeds by hash. Each match fixes an alignment of text and item; equal alignments count once.
4. The texts that have alignments meet their items' words, and each alignment is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .common import keep, mix, signed, text_or_empty, texts, word_ids

#: Positions that a mask looks at (1) and ignores (0): weight 6. Each choice of 12 of 16 places holds one of them whole.
MASKS = ("111111", "11101101", "111010101", "1101001011", "110001100011", "1100100010011")  # fixed values
#: Aligned words that are compared, and how many of them must be equal; a shorter item or text is compared whole.
SPAN, NEED = 16, 12
WEIGHT = min(m.count("1") for m in MASKS)
#: Bits of the bitmap (16 MB, whatever the benchmark's size), and how many of them a seed sets.
BITS, PROBES = 27, 3
_MULTIPLIERS = mix(np.arange(101, 133, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other non-ASCII characters; A-Z lowered."""
    return text.translate(_PLAIN).split()


def seed_hashes(ids: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask, one hash for each place of it; too short a text has none."""
    with np.errstate(over="ignore"):
        terms = [ids * m for m in _MULTIPLIERS[: max(map(len, masks))]]
        out = []
        for pattern in masks:
            n = max(0, len(ids) - len(pattern) + 1)
            total = np.full(n, np.uint64(int(pattern, 2)))
            for at, bit in enumerate(pattern):
                if bit == "1":
                    total += terms[at][at : at + n]
            out.append(mix(total))
    return out


def slices(bits: int) -> list[int]:
    """Where in a hash its places in the bitmap start."""
    return [k * (64 - bits) // (PROBES - 1) for k in range(PROBES)]


def item_seeds(items: DataFrame) -> DataFrame:
    """hash, item_id, at, width: each seed of each item (item_id, text). An item too short for a mask is one seed itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, width, found = [], [], [], [np.empty(0, np.uint64)]
            for i, text in enumerate(texts(batch)):
                ids = word_ids(normal_words(text))
                masks = MASKS if len(ids) >= WEIGHT else ("1" * len(ids),) if len(ids) else ()
                for hashes in seed_hashes(ids, masks) if masks else ():
                    found.append(hashes)
                    row.extend([i] * len(hashes)), at.extend(range(len(hashes))), width.extend([len(ids)] * len(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(found))), batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(width, pa.int32())],
                names=["hash", "item_id", "at", "width"],
            )

    return items.mapInArrow(run, "hash long, item_id long, at int, width int")


def bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """The seeds' bits, gathered as at most 2 ** bits / 64 numbers."""
    masks = [F.shiftrightunsigned("hash", at).bitwiseAND(F.lit((1 << bits) - 1)) for at in slices(bits)]
    places = seeds.select(F.explode(F.array(*masks)).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def with_hits(rows: DataFrame, held: np.ndarray, short: tuple[int, ...]) -> DataFrame:
    """Adds hits (hash, place) to rows (__row, text); the text, compressed, stays only with those that have any.

    ``short``: numbers of words of the items that are too short for a mask.
    """
    masks = (*MASKS, *("1" * n for n in short))
    shared = rows.sparkSession.sparkContext.broadcast(held)
    hits = StructType().add("hash", LongType()).add("place", IntegerType())
    schema = StructType([rows.schema["__row"]]).add("hits", ArrayType(hits)).add("body", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, press = shared.value, zstandard.ZstdCompressor(level=3)

        bits = (len(words) * 64).bit_length() - 1
        cuts, low = [np.uint64(at) for at in slices(bits)], np.uint64((1 << bits) - 1)

        def set_in(place: np.ndarray) -> np.ndarray:
            return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0

        for batch in batches:
            ends, found, places, body = [0], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
            for text in texts(batch):
                n = 0
                for hashes in seed_hashes(word_ids(normal_words(text)), masks):
                    at = np.arange(len(hashes))
                    for cut in cuts:
                        at = at[set_in((hashes[at] >> cut) & low)]
                    if len(at):
                        found.append(hashes[at]), places.append(at)
                        n += len(at)
                ends.append(ends[-1] + n)
                body.append(press.compress(text) if n else None)
            structs = pa.StructArray.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(np.concatenate(places), pa.int32())], names=["hash", "place"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(body, pa.binary())], names=["__row", "hits", "body"])

    return rows.mapInArrow(run, schema)


def best_overlap(ids: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Equal words of an alignment if it is an overlap, else 0. Item word k stands beside word k + shift of the text."""
    lo, hi = max(0, -shift), min(len(item), len(ids) - shift)
    equal = np.zeros(len(item), bool)  # words of the item beyond the text's edges are not equal
    equal[lo:hi] = ids[lo + shift : hi + shift] == item[lo:hi]
    span = min(SPAN, len(item), len(ids))
    need = span if len(item) < WEIGHT else NEED * span / SPAN
    return int(equal.sum()) if np.convolve(equal, np.ones(span, int), "valid").max() >= need else 0


def verified(candidates: DataFrame) -> DataFrame:
    """row, items (sorted ids), n_equal (of the best overlap), from rows (row, body, tries: structs item_id, shift, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            items, most = [], []
            for body, tries in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, best, known = word_ids(normal_words(unpress.decompress(body))), {}, {}
                for t in tries:
                    if t["item_id"] not in known:
                        known[t["item_id"]] = word_ids(normal_words(t["text"].encode()))
                    equal = best_overlap(ids, known[t["item_id"]], t["shift"])
                    if equal:
                        best[t["item_id"]] = max(equal, best.get(t["item_id"], 0))
                items.append(sorted(best)), most.append(max(best.values(), default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64())), pa.array(most, pa.int64())], names=["row", "items", "n_equal"])

    return candidates.mapInArrow(run, "row long, items array<long>, n_equal long")


def overlapping(docs: DataFrame, row: Column, text: Column, benchmark: DataFrame, item_col: str, item_text_col: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """All rows (row, __row, hits), and for those that overlap some item: row, items, n_equal.

    ``row`` is the struct that travels with each text. An item id with several texts stands for each of them.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), text_or_empty(item_text_col).alias("text")).where("id is not null").distinct()
    numbered = keep(items.withColumn("item_id", F.monotonically_increasing_id()))
    seeds = keep(item_seeds(numbered.select("item_id", "text")))
    short = tuple(sorted(r["width"] for r in seeds.where(F.col("width") < WEIGHT).select("width").distinct().collect()))
    every = keep(with_hits(docs.select(row.alias("__row"), text.alias("text")), bitmap(seeds, bits), short).withColumn("row", F.monotonically_increasing_id()))
    hits = every.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.hash", "hit.place")
    aligned = keep(hits.join(seeds, "hash").select("row", "item_id", (F.col("place") - F.col("at")).alias("shift")).distinct())
    tries = aligned.join(numbered, "item_id").groupBy("row").agg(F.collect_list(F.struct(F.col("id").alias("item_id"), "shift", "text")).alias("tries"))
    bodies = every.where(F.size("hits") > 0).select("row", "body")
    found = keep(verified(bodies.join(tries, "row").select("row", "body", "tries")).where(F.size("items") > 0))
    return every, found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, n_items, items (sorted ids), n_equal (of the best overlap), contaminated.

    A document is contaminated if, on some alignment, 12 of 16 consecutive words of an item equal its own; words
    beyond its edges count as unequal. The masks miss none of the 1820 ways to place 12 of 16. Of an item or a document
    of fewer than 16 words three quarters must be equal, on an alignment that a seed hit proposes: of the least such
    ways, masks miss none from 14 words on, 1 of 286 at 13, 26 of 220 at 12, and more below (whole copies of 6 words or
    more are always hit). All words of an item of fewer than 6 words must stand together. A shorter document than that
    is only compared with such items. Null texts overlap nothing; null item ids are left out; null document ids and
    repeated rows are kept as they are; empty tables are fine; other columns are ignored.
    """
    row = F.struct(F.col(id_col).cast("long").alias("doc_id"))
    every, found = overlapping(docs, row, text_or_empty(text_col), benchmark, item_col, item_text_col, bits)
    out = every.select("row", "__row.doc_id").join(found, "row", "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.col("items").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns, as ``contamination`` judges them.

    Whole rows travel with their hits through one written table; only rows with hits are shuffled. Rows with null
    texts or ids and repeated rows stay if they are clean; an empty table gives an empty one.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns])
    every, found = overlapping(docs, whole, text_or_empty(text_col), benchmark, item_col, item_text_col, bits)
    suspect = every.where(F.size("hits") > 0).join(found.select("row"), "row", "left_anti")
    clean = every.where(F.size("hits") == 0).select("__row").unionByName(suspect.select("__row"))
    return clean.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
