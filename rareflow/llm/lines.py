"""Line dedup: lines that many documents share leave every document. DataFrame functions only.

1. Lines are split once and written with a row key.
2. Each row's distinct keys are exploded and hashed to 128 bits; counting rows for a hash is one partial aggregate.
3. Lines meet the hashes over the threshold by an equi-join of two written tables, whose hot hashes adaptive execution
   may split. Only (row, place) goes on.
4. Each row's dropped places are gathered in order, and the runs of lines between them are joined.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep, text_or_empty


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else; the usual function does the same where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(SPACES)))


def hashed(lines: DataFrame, min_chars: int) -> DataFrame:
    """Replaces ``key`` by two independent 64-bit hashes; keys below ``min_chars`` go."""
    long_enough = lines.where(F.char_length("key") >= min_chars)
    return long_enough.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(1), "key")}).drop("key")


def common_lines(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """h1, h2 of the keys that at least ``min_docs`` of the rows (with ``lines``) hold."""
    keys = rows.select(F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key"))
    return hashed(keys, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h1", "h2")


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the places in ``dropped`` (ascending, from 0): the runs between them, each element copied once."""
    n = F.size(dropped)

    def run(j: Column) -> Column:
        last = F.when(j > 0, F.get(dropped, j - 1)).otherwise(-1)
        following = F.when(j < n, F.get(dropped, j)).otherwise(F.size(lines))
        return F.slice(lines, last + 2, following - last - 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), n), run))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines (before), n_dropped, text (the lines left, joined by one line feed).

    A line's key is the line without ASCII white space at its ends, A-Z lowered. Keys of ``min_chars`` code points or
    more that ``min_docs`` rows hold lose all their lines; a row counts once for a key however often it holds it. Every
    row is a document of its own, so repeated rows and rows without an id count like others. A null or empty text is one
    empty line; lines of white space have the empty key, which is only dropped at ``min_chars`` 0. An empty table gives
    an empty one; other columns are ignored.
    """
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(text_or_empty(text_col), "\n", -1).alias("lines"))
    rows = keep(split.withColumn("row", F.monotonically_increasing_id()), "zstd")
    common = keep(common_lines(rows, min_docs, min_chars))
    places = hashed(rows.select("row", F.posexplode("lines").alias("place", "line")).select("row", "place", line_key(F.col("line")).alias("key")), min_chars)
    dropped = places.join(common, ["h1", "h2"]).groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("dropped"))
    left = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.col("dropped")))
    return rows.join(dropped, "row", "left").select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(left, "\n").alias("text"),
    )


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
