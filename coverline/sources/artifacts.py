"""Stored artifacts: JSON files of rows (with metadata, or bare lists), CSV and text sinks, raw files with fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverline.operators.catalog import fingerprint
from coverline.operators.flatten import first_per

META = "struct<company_name:string,product_name:string,doc_type:string,uploaded_at:string,file_hash:string,artifact_version:string,row_count:long>"
ROW_FIELDS = [
    "insurer", "product_name", "contract_type", "contract_name", "contract_code", "reference_amount", "benefit_name", "insurance_type", "benefit_category",
    "benefit_category_ko", "trigger", "amount", "amount_condition", "reduction_note", "amount_detail", "waiting_period", "coverage_limit", "renewal_type",
    "terms_reference", "exclusions", "notes_summary", "source_pdf", "source_type", "bundle_status", "dedupe_key",
]
ROW = "struct<" + ",".join(f"{f}:string" for f in ROW_FIELDS) + ",partial:boolean>"


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(file, meta, rows) of JSON artifacts: an object with ``_meta`` and ``rows``, or a bare list; unreadable files have null rows."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.ltrim("value").alias("value"))
    whole = F.from_json("value", f"_meta {META}, rows array<{ROW}>")
    bare = F.from_json("value", f"array<{ROW}>")
    is_list = F.col("value").startswith("[")
    return raw.select("file", F.when(~is_list, whole["_meta"]).alias("meta"), F.when(is_list, bare).otherwise(whole["rows"]).alias("rows"))


def artifact_rows(artifacts: DataFrame) -> DataFrame:
    """Rows of all artifacts in order of file name, later files of a content seen before left out."""
    readable = artifacts.where("rows is not null").withColumn("h", F.coalesce(F.col("meta.file_hash"), F.lit("")))
    once = first_per(readable.where("h <> ''"), ["h"], ["file"]).unionByName(readable.where("h = ''"))
    each = once.select("file", F.posexplode("rows").alias("pos", "r"))
    return each.select("file", F.col("pos").alias("ord"), "r.*")


def prebuilt(spark: SparkSession, path: str) -> DataFrame:
    """The stored catalogue; nothing stored, nothing read."""
    from py4j.java_gateway import java_import

    jvm = spark.sparkContext._jvm
    java_import(jvm, "org.apache.hadoop.fs.Path")
    p = jvm.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"file string, ord int, {', '.join(f'{f} string' for f in ROW_FIELDS)}, partial boolean")
    return artifact_rows(read_artifacts(spark, path))


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_catalog(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as Parquet by insurer, so a picked insurer reads only its own files."""
    rows.write.mode(mode).partitionBy("insurer").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with header."""
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered lines as text, one file per section."""
    lines.repartition("section").sortWithinPartitions("section", "line_no").select("section", F.col("line").alias("value")).write.mode("overwrite").partitionBy("section").text(path)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a directory with their fingerprints."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "length", "modificationTime", fingerprint("content").alias("file_hash"), "content")


def first_file_per_directory(found: DataFrame) -> DataFrame:
    """The first file of every directory."""
    return first_per(found.drop("content").withColumn("directory", F.regexp_replace("path", "/[^/]*$", "")), ["directory"], ["path"])
