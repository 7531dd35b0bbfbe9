"""The report on a comparison: evidence, matrices, recommendations and their lines, as tables in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions.classify import cancer_class
from coverline.functions.lexicon import DEFAULT, Lexicon, canonical_key, key_action
from coverline.functions.text import text
from coverline.operators.gaps import amounts_differ, names_alone

# Evidence fields in order, and the disease definitions printed with the matrix.
FIELDS = ["benefit_name", "amount", "amount_condition", "trigger", "coverage_limit", "waiting_period", "reduction_note"]
SCOPES = [("암 정의", "C00-C97"), ("기타피부암", "C44"), ("갑상선암", "C73"), ("제자리암", "D00-D09"), ("대장점막내암", "D01")]
LINES = {"matrix": 8, "missing": 8, "different": 8, "advice": 5, "triggers": 4}


def both_sides(our: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of both sides with a side tag."""
    return our.withColumn("side", F.lit("our")).unionByName(comp.withColumn("side", F.lit("comp")), allowMissingColumns=True)


def evidence(our: DataFrame, comp: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """G1: non-blank fields of both sides in long form, each with its place (side, row, field) in the order they are numbered by."""
    rows = both_sides(our, comp)
    cells = F.array(*[F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("field"), text(f).alias("value")) for i, f in enumerate(fields)])
    side_ord = F.when(F.col("side") == "our", 0).otherwise(1)
    each = rows.select("side", side_ord.alias("side_ord"), "ord", text("benefit_name").alias("benefit"), text("contract_name").alias("contract"), F.explode(cells).alias("c"))
    return each.where("c.value <> ''").select("side", "side_ord", "ord", "c.field_ord", "c.field", "benefit", "contract", F.col("c.value").alias("value"))


def numbered(rows: DataFrame, order: list[str], name: str = "evidence_no", blocks: int | None = None) -> DataFrame:
    """Running number in an order over all rows, without putting them into one task: rows are split into ranges of the
    order, counted, and numbered within their range from the sum of the ranges before."""
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id())
    from coverline.session import cut

    ranged = cut(ranged, "numbered")
    sums = ranged.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_block").withColumn(name, F.row_number().over(Window.partitionBy("_block").orderBy(*order)) + F.col("_before")).drop("_block", "_before")


def evidence_ids(items: DataFrame) -> DataFrame:
    """The number of a (side, field, benefit); of several the last."""
    return items.groupBy("side", "field", "benefit").agg(F.max("evidence_no").alias("evidence_no"))


def appendix(items: DataFrame, width: int = 200) -> DataFrame:
    """Evidence lines with shortened text."""
    return items.select("evidence_no", "side", "field", "benefit", F.substring("value", 1, width).alias("value"))


def cell(value: Column, evidence_no: Column | None = None) -> Column:
    """A table cell: the value or a dash, with its evidence number."""
    shown = F.coalesce(F.nullif(value, F.lit("")), F.lit("—"))
    return shown if evidence_no is None else F.concat(shown, F.when(evidence_no.isNotNull(), F.format_string(" [E%d]", evidence_no)).otherwise(""))


def cancer_matrix(our: DataFrame, comp: DataFrame) -> DataFrame:
    """By class of cancer: benefits of both sides and the first two amounts of each in order."""
    rows = both_sides(our, comp).withColumn("class", cancer_class("benefit_name")).where("class <> ''")
    n = rows.groupBy("class", "side").agg(F.count_distinct("benefit_name").alias("n"))
    place = F.row_number().over(Window.partitionBy("class", "side").orderBy("ord", "amount"))  # limited to two before the shuffle
    two = rows.where(text("amount") != "").select("class", "side", "ord", "amount").withColumn("place", place).where("place <= 2")
    amounts = two.groupBy("class", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "amount"))), lambda x: x["amount"]), ", ").alias("amounts"))
    one = n.join(amounts, ["class", "side"], "left")
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return one.groupBy("class").agg(F.coalesce(side("our", "n"), F.lit(0)).alias("our_n"), F.coalesce(side("comp", "n"), F.lit(0)).alias("comp_n"), F.coalesce(side("our", "amounts"), F.lit("")).alias("our_amounts"), F.coalesce(side("comp", "amounts"), F.lit("")).alias("comp_amounts"))


def payment_matrix(our: DataFrame, comp: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """By kind of benefit: how many benefits a side has, how many with a limit and with a reduction."""
    rows = both_sides(our, comp).withColumn("action", F.coalesce(F.nullif(key_action(canonical_key("benefit_name", lexicon), lexicon), F.lit("")), F.lit("기타")))
    n = lambda s, cond: F.count_if((F.col("side") == s) & cond).cast("long")
    yes = F.lit(True)
    return rows.groupBy("action").agg(n("our", yes).alias("our_n"), n("comp", yes).alias("comp_n"), n("our", text("coverage_limit") != "").alias("our_limited"), n("comp", text("coverage_limit") != "").alias("comp_limited"), n("our", text("reduction_note") != "").alias("our_reduced"), n("comp", text("reduction_note") != "").alias("comp_reduced"))


def exclusives(our: DataFrame, comp: DataFrame) -> DataFrame:
    """Names only one side has."""
    return names_alone(our, comp)


def differences(our: DataFrame, comp: DataFrame) -> DataFrame:
    """Same names with different amounts."""
    return amounts_differ(our, comp)


def several_triggers(comparison: DataFrame) -> DataFrame:
    """Benefits with more than one trigger."""
    return comparison.where(F.size("triggers") > 1).select("ord", "benefit_name", F.size("triggers").cast("long").alias("n_triggers"))


def markdown(pairs: DataFrame, our: DataFrame, comp: DataFrame, points: DataFrame) -> DataFrame:
    """The report as (section, line_no, line), each list cut to its place on the page."""
    table = lambda df, section, order, line, limit: df.orderBy(*order).limit(limit).select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("line_no"), line.alias("line"))
    s1 = points.select(F.lit(1).alias("section"), F.col("ord").cast("int").alias("line_no"), F.format_string("- **%s** (%d) %s", "label", "n", "detail").alias("line"))
    m = cancer_matrix(our, comp)
    s2 = table(m, 2, ["class"], F.format_string("| %s | %d | %d | %s | %s |", "class", "our_n", "comp_n", cell(F.col("our_amounts")), cell(F.col("comp_amounts"))), LINES["matrix"])
    e = exclusives(our, comp).where("side = 'comp'")
    s3 = table(e, 3, ["ord", "benefit_name"], F.format_string("- 타사 단독: %s", "benefit_name"), LINES["missing"])
    d = differences(our, comp)
    s4 = table(d, 4, ["benefit_name"], F.format_string("| %s | %s | %s |", "benefit_name", cell(F.col("our_amount")), cell(F.col("comp_amount"))), LINES["different"])
    worst = pairs.where("match_type = 'matched' and advantage = '타사우위'")
    s5 = table(worst, 5, ["our_ord", "comp_ord"], F.format_string("- 검토: %s (%s → %s)", "our_name", "our_amount", "comp_amount"), LINES["advice"])
    out = s1
    for s in (s2, s3, s4, s5):
        out = out.unionByName(s)
    return out
