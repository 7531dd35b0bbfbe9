"""Detail rows to comparison rows: one row per benefit, its triggers and amounts gathered in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverline.functions import text as X
from coverline.functions.bind import let

GROUP = ("insurer", "product_name", "contract_name", "benefit_name", "renewal_type", "coverage_limit")
FIRST = ("amount", "amount_condition", "reduction_note", "waiting_period", "benefit_category", "benefit_category_ko", "source_pdf", "dedupe_key", "slots")


def comparison_rows(details: DataFrame, order: str = "ord", keep: tuple[str, ...] = FIRST) -> DataFrame:
    """A1: group key, first values, ordered distinct triggers and (amount, condition, trigger) entries, number of rows.

    Two aggregations: verbatim repeats (which may be a third of all rows) collapse on the map side of the first, so what a
    group collects in the second is bounded by its different entries. Of entries whose triggers agree in their first 80
    characters the first stands.
    """
    keep = tuple(c for c in keep if c in details.columns)
    base = details.select(F.col(order).alias("ord"), *[X.text(c).alias(c) for c in GROUP], X.text("trigger").alias("trigger"), *[(F.col(c) if c == "slots" else X.text(c)).alias(c) for c in keep])
    base = base.withColumns({"_amount": X.text("amount"), "_condition": X.text("amount_condition")})
    once = base.groupBy(*GROUP, "_amount", "_condition", "trigger").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("ord", *keep), "ord").alias("f"))
    entry = F.struct(F.col("f.ord").alias("ord"), F.col("_amount").alias("amount"), F.col("_condition").alias("condition"), X.text(F.col("f.reduction_note") if "reduction_note" in keep else F.lit("")).alias("reduction_note"), "trigger")
    groups = once.groupBy(*GROUP).agg(F.sum("n").cast("long").alias("detail_row_count"), F.min_by("f", "f.ord").alias("f"), F.array_sort(F.collect_list(entry)).alias("all"))
    key = lambda e: F.struct(e["amount"].alias("a"), e["condition"].alias("c"), F.substring(e["trigger"], 1, 80).alias("t"))
    distinct = let(F.transform("all", key), lambda keys: F.filter("all", lambda e, i: F.array_position(keys, key(e)) == i + 1))
    listed = groups.withColumns({"triggers": F.array_distinct(F.filter(F.transform("all", lambda e: e["trigger"]), lambda t: t != "")), "entries": distinct})
    many = F.size("triggers") > 1
    entries = F.transform("entries", lambda e: F.struct(e["amount"].alias("amount"), e["condition"].alias("condition"), e["reduction_note"].alias("reduction_note"), F.when(many, e["trigger"]).otherwise("").alias("trigger")))
    return listed.select(
        F.col("f.ord").alias("ord"), *GROUP, *[F.col(f"f.{c}").alias(c) for c in keep], F.coalesce(F.try_element_at("triggers", F.lit(1)), F.lit("")).alias("trigger"),
        F.when(many, F.to_json("triggers")).otherwise("").alias("trigger_variants"),
        F.when(F.size("entries") > 1, F.to_json(entries)).otherwise("").alias("amount_detail"),
        F.when(F.size("entries") > 1, entries).otherwise(F.array().cast("array<struct<amount:string,condition:string,reduction_note:string,trigger:string>>")).alias("amounts"),
        "triggers", "detail_row_count",
    )
