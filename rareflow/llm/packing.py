"""Best-fit packing by bin completion over the histogram of piece lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at
most ``capacity`` numbers, whatever the corpus) reaches the driver. There, best-fit decreasing gives an incumbent, and
a branch-and-bound over bin completions (all undominated fillings around the largest remaining length, pruned by the
waste that a better solution may still have) tries to beat it until a lower bound is met, the tree is exhausted or its
budget ends. The result is a table of bin patterns; every piece finds its bin from its rank among those of its length.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_or_empty, texts
from .vocabulary import Vocabulary

#: A bin wastes at most one FULL-th of its room to stay in ``filled_first``; the distance from the bound, as a share, from which that is
#: tried; and its budget in shifts of 4096 bits (some seconds, whatever the corpus).
FULL, GAP, WORK = 8, 256, 30_000_000

Pattern = tuple[tuple[int, int], ...]  # (length, copies), largest first
Solution = list[tuple[int, Pattern]]  # (number of bins, pattern)


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound over all thresholds."""
    number, volume = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for length, n in hist.items():
        number[length] += n
        volume[length] += n * length
    count_upto, volume_upto = np.cumsum(number), np.cumsum(volume)
    best, half = -(-int(volume_upto[-1]) // capacity), capacity // 2
    for a in range(half + 1):
        large = int(count_upto[capacity] - count_upto[capacity - a])  # longer than capacity - a
        middle = int(count_upto[capacity - a] - count_upto[half])  # (half, capacity - a]
        middle_volume = int(volume_upto[capacity - a] - volume_upto[half])
        small = int(volume_upto[half] - (volume_upto[a - 1] if a else 0))  # [a, half]
        best = max(best, large + middle + max(0, -(-(small - (middle * capacity - middle_volume)) // capacity)))
    return best


def best_fit_decreasing(hist: dict[int, int], capacity: int) -> Solution:
    """Best-fit decreasing over equal bins at once: bins with one filling and one residual move together."""
    open_bins: dict[int, list[list]] = {}
    mask, done = 0, []

    def put(residual: int, times: int, filling: list[tuple[int, int]]) -> None:
        nonlocal mask
        if residual == 0:
            done.append((times, tuple(filling)))
        else:
            open_bins.setdefault(residual, []).append([times, filling])
            mask |= 1 << residual

    def added(filling: list[tuple[int, int]], length: int, copies: int) -> list[tuple[int, int]]:
        if filling and filling[-1][0] == length:
            return [*filling[:-1], (length, filling[-1][1] + copies)]
        return [*filling, (length, copies)]

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            fits = mask >> length
            if not fits:
                per = capacity // length
                if left >= per:
                    put(capacity - per * length, left // per, [(length, per)])
                if left % per:
                    put(capacity - (left % per) * length, 1, [(length, left % per)])
                break
            residual = length + (fits & -fits).bit_length() - 1
            times, filling = open_bins[residual].pop()
            if not open_bins[residual]:
                del open_bins[residual]
                mask &= ~(1 << residual)
            copies = residual // length
            used = min(times, left // copies)
            if used:
                put(residual - copies * length, used, added(filling, length, copies))
                left -= used * copies
            else:  # fewer items than one bin of this kind takes
                used, copies = 1, left
                put(residual - copies * length, 1, added(filling, length, copies))
                left = 0
            if times > used:
                put(residual, times - used, filling)
    return done + [(t, tuple(f)) for group in open_bins.values() for t, f in group]


def fullest_bins(hist: dict[int, int], capacity: int, most: int = 4) -> tuple[Solution, int]:
    """Bins around the longest piece left, each with the fullest completion of at most ``most`` - 1 more, in as many equal
    copies as there are pieces for; and the work done, in shifts of a row of bits.

    A row of bits for each number of pieces tells which totals they reach; the completion is read back from these.
    """
    left, lengths, out, work = dict(hist), sorted(hist), [], 0
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        room = capacity - top
        usable = [x for x in lengths[: bisect_right(lengths, room)] if left[x]]
        rows = [1]
        while len(rows) < most and (row := rows[-1]):
            more = 0
            for x in usable:
                more |= row << x
            rows.append(more & ((1 << (room + 1)) - 1))
            work += len(usable)
        total, pieces = max((row.bit_length() - 1, -k) for k, row in enumerate(rows) if row)
        chosen = Counter()
        for k in range(-pieces, 0, -1):
            x = next((x for x in reversed(usable) if x <= total and left[x] > chosen[x] and rows[k - 1] >> (total - x) & 1), None)
            if x is None:  # a row counts a piece more often than there are copies: the bin stays as full as it is
                break
            chosen[x] += 1
            total -= x
        left[top] += 1
        chosen[top] += 1
        times = min(left[x] // copies for x, copies in chosen.items())
        out.append((times, tuple(sorted(chosen.items(), reverse=True))))
        for x, copies in chosen.items():
            left[x] -= times * copies
            if not left[x]:
                lengths.remove(x)
    return out, work


def filled_first(hist: dict[int, int], capacity: int, number: int) -> tuple[Solution, int]:
    """The ``number`` shortest pieces in fullest bins, as far as these are all but full; everything else by best-fit decreasing.

    Best-fit pairs long pieces early and leaves middling ones that fit nothing. Filling bins with several shorter pieces
    first makes fewer bins wherever two long ones go together anyway.
    """
    short, rest = {}, dict(hist)
    for length in sorted(hist):
        if number > 0:
            short[length] = min(hist[length], number)
            rest[length] -= short[length]
            number -= short[length]
    bins, work = fullest_bins(short, capacity)
    kept = []
    for times, pattern in bins:
        if sum(length * copies for length, copies in pattern) >= capacity - capacity // FULL:
            kept.append((times, pattern))
        else:
            for length, copies in pattern:
                rest[length] += times * copies
    return kept + best_fit_decreasing({k: v for k, v in rest.items() if v}, capacity), work


def first_solution(hist: dict[int, int], capacity: int, bound: int) -> Solution:
    """Best-fit decreasing, or where it is more than a GAP-th above the bound, the best of some ``filled_first``: shares of
    the pieces in steps of a sixteenth, then finer around the best, until the budget is used up."""
    count = lambda solution: sum(t for t, _ in solution)
    best = best_fit_decreasing(hist, capacity)
    if count(best) <= bound + bound // GAP:
        return best
    pieces, at, spent, tried = sum(hist.values()), 0.0, 0, set()
    for step in (1 / 16, 1 / 64, 1 / 256):
        around = [k / 16 for k in range(1, 17)] if step == 1 / 16 else [at + k * step for k in (-3, -2, -1, 1, 2, 3)]
        for share in around:
            number = min(pieces, round(share * pieces))
            if number <= 0 or number in tried or spent > WORK:
                continue
            tried.add(number)
            found, work = filled_first(hist, capacity, number)
            spent += work
            if count(found) < count(best):
                best, at = found, share
    return best


def undominated(left: dict[int, int], lengths: list[int], chosen: Counter, waste: int) -> bool:
    """Martello and Toth's test: no item left out may take the place of chosen items that are together no longer.

    Such an exchange needs chosen items of a total in [x - waste, x] for an item x left out: the bin it gives is no
    worse, and what is left over fits wherever x would have gone. Equal totals are no gain but for one item less.
    """
    totals = 1  # bit t: some of the chosen items have the total t
    singles = 0
    for length, copies in chosen.items():
        singles |= 1 << length
        for _ in range(copies):
            totals |= totals << length
    for x in lengths:
        if left[x] - chosen[x] <= 0:
            continue
        low = max(1, x - waste)
        window = (totals >> low) & ((1 << (x - low + 1)) - 1)
        if window & ~(1 << (x - low)):  # a smaller total that x may replace
            return False
        if window and not singles >> x & 1:  # several items of just this total
            return False
    return True


def fillings(left: dict[int, int], lengths: list[int], room: int, slack: int, steps: list[int]) -> Iterator[tuple[int, Counter]]:
    """Every undominated filling of ``room`` that wastes at most ``slack``: (waste, copies of each length).

    Depth first, longest items first, so the first ones are those of a best-fit bin. A filling that still has room for
    a remaining item is not maximal and left out. ``steps`` counts down; the search ends with its budget, not here.
    ``lengths`` is shared, not copied, and may hold lengths of which nothing is left: whoever changes it or ``left``
    between two fillings puts both back first.
    """

    reach, total = [], 0  # what all items up to here hold together, as far as that is less than the room
    for length in lengths:
        total += left[length] * length
        if total >= room:
            break
        reach.append(total)

    def go(room: int, at: int, chosen: Counter) -> Iterator[tuple[int, Counter]]:
        for i in range(min(at, bisect_right(lengths, room) - 1), -1, -1):
            length = lengths[i]
            if (i < len(reach) and reach[i] < room - slack) or steps[0] <= 0:
                break
            for copies in range(min(left[length] - chosen[length], room // length), 0, -1):
                steps[0] -= 1
                chosen[length] += copies
                yield from go(room - copies * length, i - 1, chosen)
                chosen[length] -= copies
        if room <= slack and not any(left[x] > chosen[x] for x in lengths[: bisect_right(lengths, room)]):
            yield room, +chosen

    for waste, chosen in go(room, len(lengths) - 1, Counter()):
        steps[0] -= len(lengths) // 16  # the test looks at every length
        if undominated(left, lengths, chosen, waste):
            yield waste, chosen


def complete_bins(hist: dict[int, int], capacity: int, effort: int = 200) -> tuple[Solution, int, bool]:
    """The best solution found, the lower bound, and whether the solution is proven to be the best.

    Branches on the bin of the longest remaining item: each undominated filling, first in as many equal bins as counts
    allow, then in one. A branch is cut where its waste leaves no room for a better solution than the incumbent, at first
    that of best-fit (``first_solution``), which may meet the bound at once. Otherwise the search ends when the tree is
    exhausted or after ``effort`` steps for each distinct length and as many for 256 more, whatever the corpus.
    """
    hist = {k: v for k, v in hist.items() if v > 0}
    if not hist:
        return [], 0, True
    bound = lower_bound(hist, capacity)
    best = first_solution(hist, capacity, bound)
    bins = sum(t for t, _ in best)
    total = sum(k * v for k, v in hist.items())
    left, lengths, path, waste = dict(hist), sorted(hist), [], 0
    steps = [effort * (len(hist) + 256)]
    frames: list[list] = []  # generator of (waste, times, pattern), what is placed now

    def options() -> Iterator[tuple[int, int, Pattern]]:
        top = lengths[-1]
        left[top] -= 1
        spare = (bins - 1) * capacity - total - waste
        found = fillings(left, lengths, capacity - top, spare, steps)
        while True:
            filled = next(found, None)
            left[top] += 1
            if filled is None:
                return
            w, chosen = filled
            pattern = tuple(sorted((chosen + Counter([top])).items(), reverse=True))
            most = min(left[length] // copies for length, copies in pattern)
            for times in dict.fromkeys((most, 1)):
                yield w, times, pattern
            left[top] -= 1

    def place(times: int, pattern: Pattern, sign: int) -> None:
        for length, copies in pattern:
            if left[length] == 0:
                lengths.insert(bisect_right(lengths, length), length)
            left[length] -= sign * times * copies
            if left[length] == 0:
                lengths.remove(length)

    frames.append([options(), None])
    while frames and bins > bound and steps[0] > 0:
        made, placed = frames[-1]
        if placed:
            w, times, pattern = placed
            place(times, pattern, -1)
            waste -= times * w
            path.pop()
            frames[-1][1] = None
        step = next(made, None)
        if step is None:
            frames.pop()
            continue
        w, times, pattern = step
        if waste + times * w > (bins - 1) * capacity - total:
            continue  # no better solution can waste that much
        steps[0] -= 1
        place(times, pattern, 1)
        waste += times * w
        path.append((times, pattern))
        frames[-1][1] = step
        if lengths:
            frames.append([options(), None])
        elif (n := sum(t for t, _ in path)) < bins:
            bins, best = n, list(path)
    return best, bound, bins == bound or not frames


def segments(solution: Solution) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first bin, offset of the first copy), sorted by length and rank."""
    rows, used, base = [], Counter(), 0
    for times, pattern in solution:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used[length], copies, base, offset))
            used[length] += times * copies
            offset += length * copies
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


#: The vocabulary's pre-token pattern (a fixed value of its file).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between the runs of a batch; no id has all its bytes set.
BREAK = b"\xff" * 4


class ChunkIds:
    """Token ids of each distinct run of non-space bytes, as the library gives them.

    The vocabulary's normaliser and pre-tokeniser never join text across ASCII white space, so a text's ids are the
    ids of its runs one after another. A batch's new runs are lowered and cut into pre-tokens together; the library's
    model is asked once for each new pre-token. Both tables are bounded and kept for each Python worker.
    """

    def __init__(self, path: str, runs: int = 300_000, pretokens: int = 800_000):
        self.vocabulary = Vocabulary(path)
        self.tokenizer, self.pattern = self.vocabulary.tokenizer, regex.compile(PRETOKEN + "| ")
        #: scripts for which regex and the library were not seen to agree on every code point, and letters whose lower
        #: case hangs on their neighbours, go to the library whole
        self.far = regex.compile("[^\x00-\u036f\u0400-\u052f]")
        self.limits, self.known, self.pretokens = (runs, pretokens), {}, {" ": BREAK}

    def _learn(self, runs: list[bytes]) -> None:
        text = b" ".join(runs).decode()
        special = self.vocabulary.special
        if self.far.search(text) or special is not None and special.search(text):
            odd = {r for r in runs if self.far.search(c := r.decode()) or special is not None and special.search(c)}
            for r in odd:
                self.known[r] = np.array(self.tokenizer.encode(r.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            runs = [r for r in runs if r not in odd]
            text = b" ".join(runs).decode()
        if not runs:
            return
        found = self.pattern.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        pretokens = self.pretokens
        for pretoken in set(found).difference(pretokens):
            pretokens[pretoken] = array("I", [p.id for p in self.vocabulary.pieces(pretoken)]).tobytes()
        self.known.update(zip(runs, b"".join(map(pretokens.__getitem__, found)).split(BREAK), strict=True))

    def ids(self, batch: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for at in range(0, len(batch), 64):
            split = [text.split() for text in batch[at : at + 64]]
            known = self.known
            if len(known) > self.limits[0]:
                known.clear()
            if len(self.pretokens) > self.limits[1]:
                self.pretokens = {" ": BREAK}
            new = set().union(*split).difference(known)
            if new:
                self._learn(list(new))
            for words in split:
                yield b"".join(map(known.__getitem__, words))


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document (columns doc_id and text), in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = chunk_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(encoder.ids(texts(batch))):
                ids = found + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", effort: int = 200) -> DataFrame:
    """Pack all documents into as few sequences as the search finds; one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id alone;
    a null id is kept; repeated rows are packed one by one; equal lengths are told apart by id and piece; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    keys = ["length", "doc_id", "piece", "ids_crc32"]
    # the pieces are kept before the range sort, which reads its input twice
    run = keep(keep(cut_pieces(rows, tokenizer_path, capacity, end_id)).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    # for each sorted partition and length: a partition holds a range, so these are partitions + capacity rows at most
    groups = sorted((r["p"], r["length"], r["n"], r["first"]) for r in run.groupBy(part.alias("p"), "length").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect())
    hist: Counter = Counter()
    start_of = []
    for p, length, n, first in groups:
        start_of.append((length, p, first, hist[length]))
        hist[length] += n
    solution, _, _ = complete_bins(hist, capacity, effort)
    table = spark.sparkContext.broadcast((segments(solution), np.array(sorted(start_of), dtype=np.int64).reshape(-1, 4)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, starts = table.value
        seg_key, start_key = (seg[:, 0] << 44) | seg[:, 1], (starts[:, 0] << 32) | starts[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, at = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "__at"))
            s = starts[np.searchsorted(start_key, (length << 32) | (at >> 33))]
            rank = at - s[:, 2] + s[:, 3]
            g = seg[np.searchsorted(seg_key, (length << 44) | rank, side="right") - 1]
            nth = rank - g[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(g[:, 3] + nth // g[:, 2]), pa.array(g[:, 4] + nth % g[:, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
