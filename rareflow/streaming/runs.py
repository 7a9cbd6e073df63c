"""Streams that read all there is, write to the shared folder and stop; the rows they wrote are a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import ready
from .episodes import with_state


def opened(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream, each file in the order of its time. Times without a zone are taken in the session's."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")  # a pattern may name a file or a folder
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def place(spark: SparkSession) -> str:
    ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def finish(out: DataFrame, where: str) -> DataFrame:
    """Runs an append stream until its input is used up, and gives all rows that it has ever written to ``where``.

    Its offsets and state stay beside them: a second call goes on where the first one ended.
    """
    with_state(out.sparkSession)
    query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/state").option("path", f"{where}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{where}/rows")


def finish_updates(out: DataFrame, keys: list[str], where: str) -> DataFrame:
    """Runs an update stream until its input is used up, and gives the last row of each key.

    Each micro-batch is a folder named by its number, so a batch that is repeated after a failure replaces itself.
    """
    with_state(out.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    query = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = out.sparkSession
    rows = spark.read.schema(out.schema.add("batch", "long")).parquet(f"{where}/rows")
    values = [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in values])
