"""Raw contracts to benefit rows to detail rows, and the keys that tell duplicates.

Every frame carries an order column ``ord`` (and inner orders where rows are exploded), as "first" means first read.
Null and "" are the same; a benefit without names gives one row with "", one without amounts one row with "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions import text as X

KEY_FIELDS = ("insurer", "product_name", "contract_name", "benefit_name", "amount", "amount_condition", "trigger", "source_pdf")
CONTRACT = "struct<name:string,type:string,code:string,reference_amount:string,source_pdf:string,benefits:array<struct<benefit_names:array<string>,trigger:string,amounts:array<struct<amount:string,condition:string,reduction_note:string>>>>,notes:array<string>>"


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key, by one partial aggregation instead of a sort (rows of a hot key never meet in one task)."""
    cols = df.columns
    best = df.groupBy(*[F.col(k) for k in keys]).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
    return best.select("_first.*").select(*cols)


def first_by_window(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same by ``row_number``, for types ``min_by`` can't order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_key(fields=KEY_FIELDS) -> Column:
    """First sixteen hex digits of the MD5 of the joined fields; of the trigger only the first 200 characters count."""
    parts = [F.substring(X.text(f), 1, 200) if f == "trigger" else X.text(f) for f in fields]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def all_contracts(products: DataFrame) -> DataFrame:
    """Contracts and riders (flat, or products of their own) of every product in order, the first of each (name, code, source)."""
    inner = F.flatten(F.transform(F.coalesce("riders", F.array()), lambda r: F.when(F.size(F.coalesce(r["contracts"], F.array())) > 0, r["contracts"]).otherwise(F.array(r["contract"]))))
    each = products.select(F.col("ord").alias("product_ord"), "insurer", "product_name", F.posexplode(F.concat(F.coalesce("contracts", F.array().cast(f"array<{CONTRACT}>")), inner)).alias("contract_ord", "c")).where("c is not null")
    keyed = each.withColumns({"k1": X.text(F.col("c.name")), "k2": X.text(F.col("c.code")), "k3": X.text(F.col("c.source_pdf"))})
    return first_per(keyed, ["product_ord", "k1", "k2", "k3"], ["contract_ord"]).drop("k1", "k2", "k3")


def benefit_rows(contracts: DataFrame) -> DataFrame:
    """One row per contract, benefit and name, with its amounts and the contract's notes."""
    b = contracts.select("product_ord", "contract_ord", "insurer", "product_name", "c", F.posexplode("c.benefits").alias("benefit_ord", "b"))
    names = F.when(F.size(F.coalesce("b.benefit_names", F.array())) > 0, F.col("b.benefit_names")).otherwise(F.array(F.lit("")))
    each = b.select("*", F.posexplode(names).alias("name_ord", "benefit_name"))
    amounts = F.transform(F.coalesce("b.amounts", F.array()), lambda a: F.struct(*[X.text(a[f]).alias(f) for f in ("amount", "condition", "reduction_note")]))
    return each.select(
        "product_ord", "contract_ord", "benefit_ord", "name_ord", X.text("insurer").alias("insurer"), X.text("product_name").alias("product_name"),
        X.text(F.col("c.type")).alias("contract_type"), X.text(F.col("c.name")).alias("contract_name"), X.text(F.col("c.code")).alias("contract_code"),
        X.text(F.col("c.reference_amount")).alias("reference_amount"), X.text("benefit_name").alias("benefit_name"), X.text(F.col("b.trigger")).alias("trigger"),
        amounts.alias("amounts"), F.coalesce("c.notes", F.array().cast("array<string>")).alias("notes"), X.text(F.col("c.source_pdf")).alias("source_pdf"),
    )


def detail_rows(benefits: DataFrame) -> DataFrame:
    """One row per amount, with renewal type, waiting period, limit, joined notes, the list of several amounts, and the key."""
    each = benefits.select("*", F.posexplode_outer("amounts").alias("amount_ord", "a"))
    flat = each.select(
        *[c for c in benefits.columns if c not in ("amounts", "notes")], F.coalesce("amount_ord", F.lit(0)).alias("amount_ord"),
        *[X.text(F.col(f"a.{f}")).alias(n) for f, n in (("amount", "amount"), ("condition", "amount_condition"), ("reduction_note", "reduction_note"))],
        F.when(F.size("amounts") > 1, F.to_json("amounts")).otherwise("").alias("amount_detail"),
        X.renewal_type("contract_name").alias("renewal_type"), X.waiting_period("trigger", F.array_join("notes", " ")).alias("waiting_period"),
        X.coverage_limit("trigger").alias("coverage_limit"), F.array_join("notes", " | ").alias("notes_summary"),
    )
    return flat.withColumn("dedupe_key", dedupe_key())


def distinct_details(details: DataFrame, order: list[str]) -> DataFrame:
    """The first detail row of every key."""
    return first_per(details, ["dedupe_key"], order)


def stamped(details: DataFrame, status, partial) -> DataFrame:
    """Rows with the state of their bundle."""
    return details.withColumns({"bundle_status": F.lit(status) if isinstance(status, str) else status, "partial": F.lit(partial) if isinstance(partial, bool) else partial})
