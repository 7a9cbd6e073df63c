"""Helpers shared by the corpus operators: stage tables in the shared folder, words, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts end at these ASCII white-space characters only.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, one of our own if it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


_STAGES: list[str] = []


def keep(df: DataFrame, codec: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders of the columns ``by``, and read it back.

    Cuts the lineage, survives lost executors, and gives later joins a plain scan on that side, so that adaptive
    execution may split a skewed partition. The table stays until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec, partitionBy=list(by) or None)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_tables() -> list[str]:
    """The tables that ``keep`` has written and nobody has released."""
    return _STAGES[:]


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables in the shared folder, once the results that read them are written."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _STAGES[:] = [p for p in _STAGES if p not in paths]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cpu_partitions(df: DataFrame) -> int:
    """Partitions for CPU-heavy passes: a few for each core, at least as many as the session shuffles to."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class WordIds(dict):
    """64-bit ids of words (bytes), remembered up to a bound so that memory stays fixed."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


_IDS = WordIds()


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_IDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                _POWERS[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive ids, by differences of one running polynomial sum."""
    n = len(ids)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * up[:n], dtype=np.uint64)])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]
