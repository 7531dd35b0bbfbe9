"""Duplicates hidden by formatting: canonical text, 128-bit hash, map-side counts with collision checks.

Two records are copies if all their fields agree once white space, letter case and punctuation (Unicode category P)
are taken away, and JSON fields once the order of their members is also ignored. Everything is built-in expressions:
one pass canonicalises and hashes, the only shuffle carries (hash, check, row id, count) after partial aggregation,
so a record that holds a third of all rows arrives as one partial row per map task.

Defined results: null and "" are the same field value; a record all of whose fields are empty is a record like any
other; ties and repeated rows count as copies; an empty table gives an empty result; other columns are ignored and
may have any name; text of any length is hashed whole. Unicode white space and category P as known to the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = (
    "insurer", "product_name", "contract_name", "contract_code", "reference_amount", "benefit_name", "trigger",
    "amount", "amount_condition", "reduction_note", "notes_summary",
)
JSON_FIELDS = ("amount_detail",)

_SEPARATOR = "\u0001"
_NOISE = r"(?U)[\s\p{P}]+"


def json_in_order(text: Column) -> Column:
    """A JSON list of flat objects as text whose members are sorted by key; text that is no such list stays as it is."""
    parsed = F.try_parse_json(text)
    items = F.try_variant_get(parsed, "$", "array<map<string,string>>")
    one = F.try_variant_get(parsed, "$", "map<string,string>")
    line = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("\u0002", e.key, F.coalesce(e.value, F.lit("")))), "\u0003")
    return F.when(text.rlike(r"^\s*[\[{]"), F.coalesce(F.array_join(F.transform(items, line), "\u0004"), line(one), text)).otherwise(F.coalesce(text, F.lit("")))


def canonical_text(fields=FIELDS, json_fields=JSON_FIELDS) -> Column:
    """All fields in one string without white space, case and punctuation; a separator no field can lose keeps fields apart."""
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    nested = [json_in_order(F.col(f"`{c}`").cast("string")) for c in json_fields]
    return F.lower(F.regexp_replace(F.concat_ws(_SEPARATOR, *plain, *nested), _NOISE, ""))


def hashed(rows: DataFrame, fields=FIELDS, json_fields=JSON_FIELDS, row_id: str = "row_id") -> DataFrame:
    """(row_id, h128, check): 128-bit hash of the canonical text and an independent 64-bit check of it."""
    text = rows.select(F.col(f"`{row_id}`").alias("row_id"), canonical_text(fields, json_fields).alias("canon"))
    return text.select("row_id", F.unhex(F.md5("canon")).alias("h128"), F.xxhash64("canon", F.length("canon")).alias("check"))


def collapse(rows: DataFrame, fields=FIELDS, json_fields=JSON_FIELDS, row_id: str = "row_id") -> DataFrame:
    """One row per record: (keep_row_id, n_copies). Grouping by hash and check keeps two records apart even if their 128-bit hashes collide."""
    return hashed(rows, fields, json_fields, row_id).groupBy("h128", "check").agg(F.min("row_id").alias("keep_row_id"), F.count(F.lit(1)).alias("n_copies")).select("keep_row_id", "n_copies")


def collisions(rows: DataFrame, fields=FIELDS, json_fields=JSON_FIELDS, row_id: str = "row_id") -> DataFrame:
    """Audit of the hash: (h128, n_texts) of every 128-bit value that stands for more than one canonical text."""
    sums = hashed(rows, fields, json_fields, row_id).groupBy("h128").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    return sums.where("lo <> hi").select("h128", "n_rows")


def copies_found(rows: DataFrame) -> DataFrame:
    """Records that occur at least twice."""
    return collapse(rows).where("n_copies >= 2")
