"""Phrase collocations by dynamic itemset counting over shards of the corpus.

1. One pass turns texts into rows of word ids, dealt to shards, and lists each word once for a task. Ids are 64-bit
   hashes; a grouping proves that no two words share one, and another seed is taken if two do. Languages count as words.
2. Shards are scanned in turn, again and again. Words are counted from the first step on. A longer phrase is counted
   from the step at whose start both its subphrases (all words but the last, all but the first) are known to be
   frequent, for one full cycle, so each shard is seen once. Phrases of all lengths run at the same time; the scans end
   when a whole cycle has brought nothing new.
3. Tasks know the frequent phrases of each length from a bitmap of fixed size, which only gains bits. Whether both
   subphrases were known at a step is read from it, so a bit set by chance starts a phrase early, never twice or in
   part: its counts stay exact.
4. Frequent phrases, joined by their parts, give each candidate's lowest-scoring cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, kept_tables, mix, powers, release, text_or_empty, texts

#: Shards of a cycle, words of the longest phrase, bits of the bitmap of a length (8 MB).
SHARDS, LONGEST, BITS = 2, 5, 26
#: Word ids of a row at most, but for those looked ahead; ids that a task handles at a time.
CHUNK, SLICE = 1 << 13, 1 << 19
#: Words that a task remembers; others are hashed and listed each time.
KNOWN = 400_000
#: A-Z to a-z, tabs to spaces, ends of pieces to one sign that no word can hold (fixed values).
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Groups that each language's candidates are ranked in first; each hands on no more than the report has.
SALTS = 64

WORDS = [f"w{i + 1}" for i in range(LONGEST)]


def tokens_of(text: bytes) -> list[bytes]:
    """Words, with ``.`` between pieces."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


class WordList(dict):
    """Ids of words by a seeded hash; words that are not remembered go to ``fresh``. One for each task, so that each lists all its words."""

    def __init__(self, seed: int) -> None:
        super().__init__({b".": 0})
        self.seed, self.fresh = seed, []

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed) >> 1
        self.fresh.append((value, word))
        if len(self) < KNOWN:
            self[word] = value
        return value


def encoded(docs: DataFrame, seed: int, shards: int) -> DataFrame:
    """From (lang, text): rows of ids (shard from 0) and rows of words (shard -1, ids and words).

    0 ends each piece. A row's phrases start at its first ``own`` places; what follows begins the next row as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, parts, rows, size = WordList(seed), 0, [], [], 0

        def made() -> pa.RecordBatch:
            words = [[w.decode() for _, w in known.fresh] if r[0] < 0 else [] for r in rows]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            shard, lang, own, n_words = map(list, zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(lang, pa.int64()), ids, pa.array(own, pa.int32()), pa.array(n_words, pa.int64()), pa.array(words, pa.list_(pa.string()))],
                names=["shard", "lang", "ids", "own", "n_words", "words"],
            )

        def flushed() -> Iterator[pa.RecordBatch]:
            if known.fresh:
                parts.append(np.array([i for i, _ in known.fresh], np.int64)), rows.append((-1, None, 0, 0))
            if rows:
                yield made()
            parts.clear(), rows.clear(), known.fresh.clear()

        for batch in batches:
            for name, text in zip(texts(batch, "lang"), texts(batch), strict=True):
                lang = known[name]
                tokens = tokens_of(text)
                ids = np.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), 0)
                for start in range(0, len(ids), CHUNK):
                    own = min(CHUNK, len(ids) - start)
                    piece = ids[start : start + CHUNK + LONGEST - 1]
                    parts.append(piece if piece[-1] == 0 else np.append(piece, 0))
                    rows.append((number % shards, lang, own, int(np.count_nonzero(piece[:own]))))
                    number, size = number + 1, size + own
                if size >= SLICE // 4:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return docs.select("lang", "text").mapInArrow(run, "shard int, lang long, ids array<long>, own int, n_words long, words array<string>")


def coded_corpus(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The written rows of ids, and (id, word) of every word, with an id that no other word has."""
    for seed in count(1):
        rows = keep(encoded(docs, seed, shards), "zstd", ("shard",))
        listed = rows.where("shard = -1").select(F.explode(F.arrays_zip("ids", "words")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.words").alias("word"))
        words = keep(listed.distinct())
        if not words.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id = 0").limit(1).count():
            return rows, words
        release(docs.sparkSession, *kept_tables()[-2:])


class Hashes:
    """Hashes of the runs of m ids, with the language of their place, for any m: differences of one running polynomial sum."""

    def __init__(self, ids: np.ndarray, lang: np.ndarray) -> None:
        up, self.down = powers(len(ids) + 1)
        self.lang = lang.view(np.uint64)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids.view(np.uint64) * up[:-1], dtype=np.uint64)])

    def at(self, starts: np.ndarray, m: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[starts + m] - self.total[starts]) * self.down[starts] + self.lang[starts] * np.uint64(2 * m + 1))


def packed(bitmap: np.ndarray) -> bytes:
    """A bitmap with few bits set travels as some kilobytes."""
    return zstandard.ZstdCompressor(level=1).compress(bitmap)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint64)


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)


def is_known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where both of a hash's places are set."""
    one, two = ((bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) for p in places(hashes, (len(bitmap) * 64).bit_length() - 1))
    return (one & two) != 0


def occurrences(shard: DataFrame, shared: Broadcast, words: bool) -> DataFrame:
    """lang, w1 to w5 (0 beyond the phrase), n: this shard's running phrases, summed up over each slice of a task.

    ``shared``: for a length m, the bitmaps (``packed``) of frequent phrases of m words now and a cycle ago. A phrase of
    m + 1 words runs if both its subphrases are in the first, and not both in the second. ``words``: whether words run.
    """

    def grouped(lang: np.ndarray, ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, m: int) -> pa.RecordBatch:
        order = np.argsort(hashes)
        starts, hashes = starts[order], hashes[order]
        first = np.ones(len(starts), bool)  # where the hash, or whatever shares it, changes
        first[1:] = hashes[1:] != hashes[:-1]
        for column in (lang, *(ids[k:] for k in range(m))):
            held = column[starts]
            first[1:] |= held[1:] != held[:-1]
        at = np.flatnonzero(first)
        n, starts = np.diff(np.append(at, len(starts))), starts[at]
        none = np.zeros(len(at), np.int64)
        columns = [lang[starts], *(ids[starts + k] if k < m else none for k in range(LONGEST)), n]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", *WORDS, "n"])

    def handled(batches: list[pa.RecordBatch], known: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        lists = table.column(1).combine_chunks()
        ids, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        lang = np.repeat(table.column(0).to_numpy(), sizes)
        own = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(table.column(2).to_numpy(), sizes)
        whole, hashes = ids != 0, Hashes(ids, lang)
        if words and (own & whole).any():
            starts = np.flatnonzero(own & whole)
            yield grouped(lang, ids, starts, ids[starts] ^ lang[starts], 1)
        for m, (now, before) in sorted(known.items()):
            n = len(ids) - m + 1  # places where m words may start
            if n < 2:
                continue
            inside = np.flatnonzero(np.logical_and.reduce([whole[k : k + n] for k in range(m)]))
            found = np.zeros(n, np.uint64)  # the hash of a frequent phrase of m words that starts here
            found[inside] = hashes.at(inside, m)
            frequent = np.zeros(n, bool)
            frequent[inside] = is_known(now, found[inside])
            starts = np.flatnonzero(frequent[:-1] & frequent[1:] & own[: n - 1])
            starts = starts[~(is_known(before, found[starts]) & is_known(before, found[starts + 1]))]
            if len(starts):
                with np.errstate(over="ignore"):
                    longer = mix(found[starts] + found[starts + 1] * np.uint64(3))
                yield grouped(lang, ids, starts, longer, m + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = {m: tuple(map(unpacked, pair)) for m, pair in shared.value.items()}, [], 0
        for batch in batches:
            sizes, first = np.diff(batch.column(1).offsets.to_numpy()), 0
            for at, n in enumerate(sizes.tolist(), 1):
                size += n
                if size >= SLICE:
                    yield from handled([*held, batch.slice(first, at - first)], known)
                    held, size, first = [], 0, at
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield from handled(held, known)

    return shard.select("lang", "ids", "own").mapInArrow(run, f"lang long, {', '.join(f'{w} long' for w in WORDS)}, n long")


def set_bits(phrases: DataFrame, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the phrases, the words of its bitmap that have bits, and these: at most 2 ** bits / 64 for a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lang = np.stack([batch.column(1 + k).to_numpy() for k in range(LONGEST)], 1), batch.column(0).to_numpy()
            sizes = np.count_nonzero(ids, 1)
            for m in set(sizes.tolist()):
                rows = np.flatnonzero(sizes == m)
                hashes = Hashes(ids[rows, :m].ravel(), np.repeat(lang[rows], m)).at(np.arange(len(rows)) * m, m)
                at = np.concatenate(places(hashes, bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, np.int32)), pa.array(at)], names=["m", "place"])

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    at = phrases.select("lang", *WORDS).mapInArrow(run, "m int, place long")
    held = at.groupBy("m", F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    m, word, value = (held.column(c).to_numpy() for c in ("m", "word", "bits"))
    return {int(k): (word[m == k], value[m == k].view(np.uint64)) for k in np.unique(m)}


def frequent_phrases(rows: DataFrame, least: int, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """lang, w1 to w5, n of every phrase of up to ``longest`` words with n >= ``least``.

    A phrase that has been counted for a cycle since it was first seen is whole: it goes to the result or away.
    """
    none = np.zeros(1 << (bits - 6), np.uint64)
    maps = {m: none for m in range(1, longest)}
    past = [maps] * shards  # the bitmaps of the last steps; arrays that did not change are shared
    running, paths, done, step = None, [], [], 0
    while True:
        known = {m: (maps[m], past[0][m]) for m in maps if maps[m] is not past[0][m]}
        if step >= shards and not known:
            break
        shared = rows.sparkSession.sparkContext.broadcast({m: tuple(map(packed, pair)) for m, pair in known.items()})
        found = occurrences(rows.where(F.col("shard") == step % shards), shared, step < shards)
        seen = F.when(F.col("w2") == 0, 0).otherwise(step).alias("seen")
        both = found.select("lang", *WORDS, "n", seen, F.lit(None).cast("int").alias("reached"))
        both = both if running is None else running.unionByName(both)
        summed = both.groupBy("lang", *WORDS).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"), F.min("reached").alias("reached"))
        summed = summed.withColumn("reached", F.coalesce("reached", F.when(F.col("n") >= least, step)))
        whole = F.col("seen") <= step + 1 - shards
        table = keep(summed.where(F.col("reached").isNotNull() | ~whole), "zstd")
        shared.destroy()
        added = set_bits(table.where((F.col("reached") == step) & (F.col(f"w{longest}") == 0)), bits)
        past, maps = [*past[1:], maps], dict(maps)
        for m, (word, value) in added.items():
            maps[m] = maps[m].copy()
            maps[m][word] |= value
        done.append(table.where(whole).select("lang", *WORDS, "n"))
        running = table.where(~whole)
        step += 1
    # the last running phrases have had their cycle: nothing new came for as long
    done.append(running.where("reached is not null").select("lang", *WORDS, "n"))
    return keep(union(done), "zstd")


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def best_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score, k of the lowest-scoring cut of each phrase (array of ids) of two words or more."""
    size = F.size("phrase")
    cuts = phrases.where(size > 1).select("lang", "phrase", F.col("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, size - F.col("k"))})
    parts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    parts = parts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    score = F.call_function("div", F.lit(1000) * wide["a"] * wide["n"], wide["l"] * wide["r"])
    lowest = parts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("x"))
    return lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score", "x.k")


def in_longer(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longer: the largest count of a longer phrase that holds this one; only phrases of two words or more."""
    size = F.size("phrase")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.struct(s.alias("s"), m.alias("m")))))
    inner = phrases.where(size > 2).select("lang", "a", F.col("phrase").alias("whole"), F.explode(spans).alias("x"))
    return inner.select("lang", "a", F.slice("whole", F.col("x.s"), F.col("x.m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``text``, the words joined by spaces, to the rows of a written table."""
    each = phrases.select("lang", "phrase", F.posexplode("phrase").alias("at", "id")).join(words, "id")
    spelled = each.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    return phrases.join(spelled, ["lang", "phrase"])


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, percent: int = 100, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` (at most 5) words.

    A phrase with at least ``least`` occurrences in pieces of text is a candidate; it goes if a longer one that holds its
    words together has ``percent`` of its occurrences. Its score is 1000 * a * n / (l * r), rounded down, of the cut
    with the lowest score (ties: the shortest first part); ranks go by score and a, from the largest, then by phrase.
    A null text is empty, a null language is ``und``. Repeated rows count as often as they stand. Texts and pieces of any
    length are counted whole; a table without candidates gives an empty result; other columns are ignored.
    ``shards`` and ``bits`` change the work, never the rows.
    """
    rows, words = coded_corpus(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text")), shards)
    totals = rows.where("shard >= 0").groupBy("lang").agg(F.sum("n_words").alias("n"))
    held = frequent_phrases(rows, least, longest, shards, bits)
    phrases = held.select("lang", F.filter(F.array(*WORDS), lambda w: w != 0).alias("phrase"), F.col("n").alias("a"))
    inner = in_longer(phrases)
    kept = best_cuts(phrases, totals).join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    named = spelled(keep(kept.drop("longer", "k")), words)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("text")]
    few = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    names = words.withColumnsRenamed({"id": "lang", "word": "name"})
    return ranked.join(names, "lang").select(F.col("name").alias("lang"), "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
