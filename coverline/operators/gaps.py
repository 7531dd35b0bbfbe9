"""Quality reports over the catalogue: categories, names without a slot, keys only one insurer has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverline.functions.lexicon import DEFAULT, Lexicon, canonical_key, is_raw, key_action
from coverline.functions.text import match_text, text


def other_share(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """A10: share of rows without a category, and whether it exceeds the threshold."""
    other = text("benefit_category") == "other"
    t = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(other).cast("long").alias("n_other"))
    share = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(F.col("n_other") / F.col("n_rows"))
    return t.withColumn("share", share).withColumn("alert", F.col("share") > threshold)


def category_distribution(rows: DataFrame) -> DataFrame:
    """Rows by category with their share and the place of the first."""
    n = rows.groupBy(text("benefit_category").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    total = rows.agg(F.count(F.lit(1)).alias("total")).select(F.lit(1).alias("one"), "total")
    return n.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("category", "n", "first_ord", (F.col("n") / F.col("total")).alias("share"))


def keyed_names(rows: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Distinct names with key and action (keys are worked out once per name, not per row)."""
    names = rows.where(text("benefit_name") != "").groupBy("benefit_name").agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = names.withColumn("key", canonical_key("benefit_name", lexicon))
    return keyed.withColumns({"action": key_action(F.col("key"), lexicon), "raw": is_raw("benefit_name", F.col("key"))})


def unmapped(rows: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Names whose key is only the name itself, with the last row's category."""
    last = rows.groupBy("benefit_name").agg(F.max_by(text("benefit_category"), "ord").alias("category"))
    return keyed_names(rows, lexicon).where("raw").join(last, "benefit_name").select("benefit_name", "n_rows", "category")


def without_action(rows: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Names with a slot but no kind of benefit."""
    return keyed_names(rows, lexicon).where("not raw and action = ''").select("benefit_name", "n_rows", "key")


def solo_keys(rows: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Keys that only one insurer has; counted over distinct (insurer, name), so no row is compared with others."""
    names = rows.where((text("benefit_name") != "") & (text("insurer") != "")).groupBy("insurer", "benefit_name").agg(F.count(F.lit(1)).alias("n"))
    keys = names.select("benefit_name").distinct().withColumn("key", canonical_key("benefit_name", lexicon))
    per = names.join(keys, "benefit_name").groupBy("key").agg(F.count_distinct("insurer").alias("n_insurers"), F.min("insurer").alias("insurer"), F.sum("n").alias("n_rows"))
    return per.where("n_insurers = 1").select("key", "insurer", "n_rows")


def names_alone(our: DataFrame, comp: DataFrame) -> DataFrame:
    """Names only one side has, each once with its first order."""
    one = lambda a, b, side: a.groupBy("benefit_name").agg(F.min("ord").alias("ord")).join(b.select("benefit_name").distinct(), "benefit_name", "left_anti").withColumn("side", F.lit(side))
    return one(our, comp, "our").unionByName(one(comp, our, "comp")).select("side", "benefit_name", "ord")


def amounts_differ(our: DataFrame, comp: DataFrame) -> DataFrame:
    """Names both sides have with another amount (of a name that repeats, the last row stands)."""
    last = lambda df, p: df.groupBy("benefit_name").agg(F.max_by(text("amount"), "ord").alias(f"{p}_amount"))
    return last(our, "our").join(last(comp, "comp"), "benefit_name").where("our_amount <> comp_amount")


def normalized_names(rows: DataFrame) -> DataFrame:
    """Distinct names with their match text."""
    return rows.where(text("benefit_name") != "").select("benefit_name").distinct().withColumn("match_text", match_text("benefit_name"))
