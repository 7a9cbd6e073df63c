"""Token counts without token ids: pieces once per distinct pre-token, joined to every document's frequencies.

1. One narrow pass writes each document's pre-token frequencies.
2. The corpus's distinct pre-tokens are grouped, and the library's model is asked once for each: a table of pieces.
3. Frequencies are joined to that table and summed by document. The pre-tokens of most documents, a bounded number of
   bounded length, are a broadcast side, so no frequent pre-token is ever a shuffle key; all others are rare by choice
   and join by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cpu_partitions, keep, text_or_empty, texts
from .vocabulary import Vocabulary, loaded

#: The byte-level pre-token pattern of the vocabulary (a fixed value; see the tokenizer folder's PATTERN).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The broadcast side has at most so many pre-tokens of at most so many bytes: some 40 MB with its overhead.
HEAD, HEAD_BYTES = 300_000, 64
#: Pre-tokens of the texts that a task holds as Python strings at a time, but for those of a single text.
SLICE = 200_000


def frequencies(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes, n_special (special strings, a token each), pretokens, times."""
    pattern = PRETOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, find = loaded(tokenizer_path).special, regex.compile(pattern).findall
        def made(ids: pa.Array, size: list[int], n_special: list[int], ends: list[int], pretokens: list[str], times: list[int]) -> pa.RecordBatch:
            at = pa.array(ends, pa.int32())
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(n_special, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(pretokens, pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))],
                names=["doc_id", "n_bytes", "n_special", "pretokens", "times"],
            )

        for batch in batches:
            first, held = 0, ([], [], [0], [], [])
            for i in range(batch.num_rows):
                (raw,) = texts(batch.slice(i, 1))
                text = raw.decode()
                if special is None or not special.search(text):
                    found, n = Counter(find(text)), 0
                else:
                    parts = special.split(text)
                    found, n = Counter(x for part in parts for x in find(part)), len(parts) - 1
                size, n_special, ends, pretokens, times = held
                size.append(len(raw)), n_special.append(n)
                pretokens.extend(found), times.extend(found.values())
                ends.append(len(times))
                if len(times) >= SLICE:
                    yield made(batch.column(0).slice(first, i + 1 - first), *held)
                    first, held = i + 1, ([], [], [0], [], [])
            yield made(batch.column(0).slice(first), *held)

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_special long, pretokens array<string>, times array<long>")


def pieces_of(distinct: DataFrame, tokenizer_path: str) -> DataFrame:
    """pretoken, docs, pieces: the model's answer for each distinct pre-token (columns pretoken and docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = loaded(tokenizer_path)
        for batch in batches:
            pieces = [len(vocabulary.pieces(p)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["pretoken", "docs", "pieces"])

    return distinct.select("pretoken", "docs").mapInArrow(run, "pretoken string, docs long, pieces long")


def head_threshold(counted: DataFrame, head: int) -> int:
    """About the least number such that at most ``head`` pre-tokens are in so many documents.

    Exact numbers up to 1000, then their two leading digits: about 2500 counts at most reach the driver.
    """
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.length(F.col("docs").cast("string")) - F.lit(3))).cast("long")
    counts = counted.groupBy((F.floor(F.col("docs") / scale) * scale).alias("least")).agg(F.count("*").alias("n")).collect()
    held, threshold = 0, (1 << 63) - 1
    for least, n in sorted(((r["least"], r["n"]) for r in counts), reverse=True):
        held += n
        if held > head:
            break
        threshold = least
    return threshold


def token_counts(docs: DataFrame, tokenizer_path: str, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > budget).

    Null or empty text gives 0 bytes and 0 tokens; a null id is kept; repeated rows each give a row; an empty table
    gives an empty result; other columns are ignored. ``head`` bounds the broadcast side; any value gives the same
    counts. Texts are read once; frequencies and the table of pieces are written in the shared folder.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = keep(frequencies(rows, tokenizer_path).withColumn("row", F.monotonically_increasing_id()), "zstd")
    distinct = held.select(F.explode("pretokens").alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("docs"))
    counted = keep(pieces_of(distinct.repartition(cpu_partitions(docs), "pretoken"), tokenizer_path))
    frequent = (F.col("docs") >= head_threshold(counted, head)) & (F.octet_length("pretoken") <= HEAD_BYTES)
    common = counted.where(frequent).select("pretoken", F.col("pieces").alias("known"))
    rare = counted.where(~frequent).select("pretoken", "pieces")
    long = held.select("row", F.explode(F.arrays_zip("pretokens", "times")).alias("x")).select("row", F.col("x.pretokens").alias("pretoken"), F.col("x.times").alias("times"))
    looked_up = long.join(F.broadcast(common), "pretoken", "left")
    # one row for each document, partial sums first; what the broadcast side does not know goes on to the other join
    from_head = looked_up.where("known is not null").groupBy("row").agg(F.sum(F.col("times") * F.col("known")).alias("n"))
    from_tail = looked_up.where("known is null").select("row", "pretoken", "times").join(rare, "pretoken").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n"))
    summed = from_head.unionByName(from_tail).groupBy("row").agg(F.sum("n").alias("n"))
    n_tokens = F.coalesce("n", F.lit(0)) + F.col("n_special")
    return held.select("row", "doc_id", "n_bytes", "n_special").join(summed, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > F.lit(budget)).alias("over_limit"))
