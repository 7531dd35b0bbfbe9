"""The catalogue of detail rows: union of stored batches, guards against repeats, pickers and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.functions.text import text
from coverline.operators.flatten import dedupe_key, first_per

ALL = "(전체)"
FINGERPRINT_BYTES = 65_536


def fingerprint(content, first_bytes: int | None = FINGERPRINT_BYTES) -> Column:
    """First 32 hex digits of the SHA-256 of the first 64 KiB (or, with None, of everything)."""
    data = F.col(content) if isinstance(content, str) else content
    return F.substring(F.sha2(data if first_bytes is None else F.substring(data, 1, first_bytes), 256), 1, 32)


def union_all(*sources: DataFrame) -> DataFrame:
    """Sources in order of precedence, with ``src`` and the rows' own ``ord``."""
    out = None
    for i, df in enumerate(sources):
        tagged = df.withColumn("src", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def with_keys(rows: DataFrame) -> DataFrame:
    """Rows whose blank key is filled in."""
    return rows.withColumn("dedupe_key", F.coalesce(F.nullif("dedupe_key", F.lit("")), dedupe_key()))


def load_all(*sources: DataFrame) -> DataFrame:
    """All sources, missing keys made, the first row of every key."""
    return first_per(with_keys(union_all(*sources)), ["dedupe_key"], ["src", "ord"])


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same key."""
    return existing.join(new.select("dedupe_key").distinct(), "dedupe_key", "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(batch: DataFrame, stored: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Artifacts of a batch whose content is not stored; blank hashes always count as unseen."""
    known = stored.where(text(hash_col) != "").select(hash_col).distinct()
    return batch.join(known, hash_col, "left_anti")


def first_uploads(artifacts: DataFrame, order: list[str], hash_col: str = "file_hash") -> DataFrame:
    """The first artifact of every content; artifacts without a hash all stay."""
    blank = artifacts.where(text(hash_col) == "")
    return first_per(artifacts.where(text(hash_col) != ""), [hash_col], order).unionByName(blank)


def companies(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Insurers with the place of their first row."""
    return rows.where(text("insurer") != "").groupBy("insurer").agg(F.min(order).alias("first_ord"))


def in_context(rows: DataFrame, company: str | None, product: str = ALL, rider: str = ALL) -> DataFrame:
    """Rows of a company, and of a product and a contract unless all are meant; no company, no rows."""
    if not company:
        return rows.where(F.lit(False))
    out = rows.where(F.col("insurer") == company)
    for column, value in (("product_name", product), ("contract_name", rider)):
        if value and value != ALL:
            out = out.where(F.col(column) == value)
    return out


def choices(rows: DataFrame, column: str) -> DataFrame:
    """O1: distinct values for a picker."""
    return rows.where(text(column) != "").select(column).distinct()


def counts(rows: DataFrame) -> DataFrame:
    """Companies, products and rows."""
    return rows.agg(F.count_distinct("insurer").alias("companies"), F.count_distinct("product_name").alias("products"), F.count(F.lit(1)).alias("n_rows"))


def filled_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """P5: (column, filled): whether a column has any value, from one aggregation over all columns."""
    one = rows.agg(*[F.max(text(c) != "").alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(False)).alias("filled")) for c in columns])).alias("x")).select("x.*")


def meta(rows: DataFrame, doc_type: str = "summary", version: str = "2.0") -> DataFrame:
    """One record of metadata for a set of rows to store."""
    return rows.agg(F.first("insurer", True).alias("company_name"), F.first("product_name", True).alias("product_name"), F.lit(doc_type).alias("doc_type"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("uploaded_at"), F.lit(version).alias("artifact_version"), F.count(F.lit(1)).alias("row_count"))
