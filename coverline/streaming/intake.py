"""Structured Streaming over a directory of row files: keys made, repeats within the watermark dropped, appended by insurer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coverline.operators.catalog import with_keys
from coverline.sources.artifacts import ROW_FIELDS

SCHEMA = ", ".join(f"{f} string" for f in ROW_FIELDS) + ", partial boolean, received_at timestamp"


def read_rows(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of JSON-line files as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def accepted(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """The first row of every key; state is kept as long as rows may be late."""
    return with_keys(rows.where("received_at is not null")).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["dedupe_key"])


def per_day(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows and insurers by day of receipt."""
    return rows.withWatermark("received_at", late).groupBy(F.window("received_at", "1 day").alias("w"), "insurer").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "insurer", "n")


def write_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet catalogue until what is there has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("insurer").outputMode("append").trigger(availableNow=True).start()
