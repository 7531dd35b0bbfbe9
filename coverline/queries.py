"""Registered queries of the core operators, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions import amounts as A
from coverline.functions import classify as C
from coverline.functions import text as X
from coverline.functions.lexicon import DEFAULT, canonical_key, is_raw, key_action, masked, slot_label
from coverline.operators import catalog, collapse, compare, flatten, gaps, layout, matching, report
from coverline.plans.comparison import compare_sides, side
from coverline.session import table
from coverline.sources import providers

OUR, COMP = "해솔빛화재", "달무리화재"
BIG = lambda c: F.col(c).cast("long").alias(c)


def details(spark, d) -> DataFrame:
    return table(spark, d, "summary_rows").withColumn("ord", F.col("row_id"))


# --- units -----------------------------------------------------------------------------------------------------------


def p3_found(spark, d):
    from coverline.operators.units import common_amounts, common_periods

    return common_amounts(table(spark, d, "summary_rows")).unionByName(common_periods(table(spark, d, "amount_entries")))


# --- text and amounts ------------------------------------------------------------------------------------------------


def clean_whitespace(spark, d):
    return details(spark, d).select("row_id", X.clean("trigger").alias("cleaned"), X.squeeze("benefit_name").alias("squeezed"))


def joined_names(spark, d):
    return details(spark, d).select("row_id", X.joined_name("trigger").alias("joined"))


def letter_spacing(spark, d):
    return details(spark, d).select("row_id", X.unspaced("contract_name").alias("unspaced"))


def split_names(spark, d):
    return details(spark, d).select("row_id", F.posexplode(X.split_names("benefit_name")).alias("pos", "name")).select("row_id", BIG("pos"), "name")


def note_repair(spark, d):
    return details(spark, d).select("row_id", X.note_text("notes_summary").alias("note"))


def note_split(spark, d):
    joined = X.note_text(F.replace(X.text("notes_summary"), F.lit(" | "), F.lit("\n")))
    return details(spark, d).select("row_id", F.posexplode(X.numbered_notes(joined)).alias("pos", "note")).select("row_id", BIG("pos"), "note")


def extracted_terms(spark, d):
    page = F.concat(F.lit("(기준 : 특약가입금액 "), X.text("amount"), F.lit(")"))
    return details(spark, d).select("row_id", X.renewal_type("contract_name").alias("renewal"), X.waiting_period("trigger", "notes_summary").alias("waiting"), X.coverage_limit("trigger").alias("cov_limit"), X.reference_amount(page).alias("reference"))


def amount_won(spark, d):
    return details(spark, d).select("row_id", A.won("amount").alias("won"))


def limits(spark, d):
    lim = A.limit(F.coalesce(F.nullif("coverage_limit", F.lit("")), "trigger"))
    return details(spark, d).select("row_id", lim.alias("l")).select("row_id", F.col("l.unit").alias("unit"), F.col("l.n").alias("n"))


def short_conditions(spark, d):
    return table(spark, d, "amount_entries").select("entry_id", A.short_condition("condition").alias("short"))


def _cells(spark, d):
    e = table(spark, d, "amount_entries")
    cell = F.concat_ws(" ", F.nullif(X.text("condition"), F.lit("")), F.nullif(X.text("amount"), F.lit("")), F.when(X.text("reduction_note") != "", F.concat(F.lit("(단, 보험계약일부터 1년 "), X.text("reduction_note"), F.lit(" 지급)"))))
    return e.select("entry_id", cell.alias("cell"))


def amount_cells(spark, d):
    got = _cells(spark, d).select("entry_id", F.posexplode(A.cell_amounts("cell")).alias("pos", "e"))
    return got.select("entry_id", BIG("pos"), F.col("e.condition").alias("condition"), F.col("e.amount").alias("amount"), F.col("e.reduction_note").alias("reduction_note"))


def amount_display(spark, d):
    return details(spark, d).select("row_id", A.display("amount", "amount_condition", A.detail(F.col("amount_detail"))).alias("shown"))


def amount_info(spark, d):
    return details(spark, d).select("row_id", A.info("amount", "amount_condition", A.detail(F.col("amount_detail"))).alias("i")).select("row_id", F.col("i.value").alias("value"), F.col("i.conditional").alias("conditional"), F.col("i.note").alias("note"))


def _neighbours(spark, d):
    w = Window.partitionBy("artifact_id").orderBy("row_id")
    rows = details(spark, d)
    return rows.select("row_id", *[X.text(c).alias(c) for c in ("amount", "reduction_note", "coverage_limit", "amount_condition")], *[X.text(F.lead(c).over(w)).alias(f"next_{c}") for c in ("amount", "reduction_note", "coverage_limit", "amount_condition")])


def amount_similarity(spark, d):
    return _neighbours(spark, d).select("row_id", F.round(A.similarity("amount", "next_amount"), 9).alias("similarity"))


def slot_verdicts(spark, d):
    v = compare.slot_verdict
    return _neighbours(spark, d).select("row_id", v("numeric", "amount", "next_amount").alias("amount_v"), v("limit_numeric", "coverage_limit", "next_coverage_limit").alias("limit_v"), v("none_is_better", "reduction_note", "next_reduction_note").alias("reduction_v"), v("display_only", "amount_condition", "next_amount_condition").alias("condition_v"), v("rank", "amount_condition", "next_amount_condition", True, ["매월", "매년", "매회"]).alias("rank_v"))


# --- lexicon and classification --------------------------------------------------------------------------------------


def _names(spark, d):
    return details(spark, d).where(X.text("benefit_name") != "").select("benefit_name").distinct()


def match_texts(spark, d):
    return _names(spark, d).select("benefit_name", X.match_text("benefit_name").alias("match_text"), X.without_type(X.match_text("benefit_name")).alias("bare"))


def canonical_keys(spark, d):
    keyed = _names(spark, d).withColumn("key", canonical_key("benefit_name"))
    return keyed.select("benefit_name", "key", key_action(F.col("key")).alias("action"), is_raw("benefit_name", F.col("key")).alias("raw"))


def canonical_key_counts(spark, d):
    keyed = _names(spark, d).withColumn("key", canonical_key("benefit_name"))
    return details(spark, d).where(X.text("benefit_name") != "").join(keyed, "benefit_name").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def masked_names(spark, d):
    return _names(spark, d).select("benefit_name", masked(X.match_text("benefit_name"), DEFAULT).alias("masked"), slot_label(X.match_text("benefit_name"), DEFAULT, "action").alias("action"))


def document_types(spark, d):
    docs = table(spark, d, "documents").select("doc_id", C.document_type(F.lit(""), "text").alias("by_text"), C.document_type(F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_type") == "terms", "_약관.pdf").otherwise("_S.pdf")), "text").alias("by_name"))
    return docs.select("doc_id", "by_text", "by_name", C.resolved_type(F.col("by_text"), F.length("by_text") - 7).alias("resolved"))


def insurance_types(spark, d):
    return table(spark, d, "contracts").select("contract_id", C.insurance_type("product_name", "source_pdf").alias("kind"), C.cancer_class("contract_name").alias("cancer"))


def benefit_categories(spark, d):
    kind = C.insurance_type("product_name", "source_pdf")
    rows = details(spark, d).select("row_id", "benefit_name", "trigger", kind.alias("kind"))
    return rows.withColumn("c", C.benefit_category("benefit_name", "trigger", F.col("kind"))).select("row_id", F.col("c.category").alias("category"), F.col("c.label").alias("label"))


def categories_filled(spark, d):
    rows = details(spark, d).withColumn("benefit_category", F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("benefit_category")))
    got = C.filled_categories(rows.withColumn("kind", C.insurance_type("product_name", "source_pdf")), "kind")
    return got.select("row_id", "benefit_category", "benefit_category_ko")


def upload_types(spark, d):
    names = details(spark, d).select(F.concat(F.lit("/in/"), X.text("source_pdf")).alias("path")).distinct()
    return C.classified_uploads(names.withColumn("first_pages", F.lit("")))


def other_ratio(spark, d):
    return gaps.other_share(details(spark, d)).select("n_rows", "n_other", F.round("share", 9).alias("share"), "alert")


def category_distribution(spark, d):
    return gaps.category_distribution(details(spark, d)).select("category", "n", "first_ord", F.round("share", 9).alias("share"))


def unmapped_names(spark, d):
    return gaps.unmapped(details(spark, d))


def names_without_action(spark, d):
    return gaps.without_action(details(spark, d))


def solo_keys(spark, d):
    return gaps.solo_keys(details(spark, d))


# --- flatten, keys, catalogue ----------------------------------------------------------------------------------------


def _products(spark, d):
    """Raw products made of contracts and the amounts of their rows: main contracts flat, every other rider as a product of its own."""
    e = table(spark, d, "amount_entries").where("row_id is not null")
    amounts = e.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "entry_id", "amount", "condition", "reduction_note"))), lambda x: F.struct(x["amount"].alias("amount"), x["condition"].alias("condition"), x["reduction_note"].alias("reduction_note"))).alias("amounts"))
    rows = details(spark, d).where("product_name is not null and contract_name is not null").select("row_id", "product_name", "contract_name", "benefit_name", "trigger")
    b = rows.join(amounts, "row_id", "left").groupBy("product_name", "contract_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "benefit_name", "trigger", "amounts"))), lambda x: F.struct(F.when(x["benefit_name"].isNull(), F.array().cast("array<string>")).otherwise(F.array(x["benefit_name"])).alias("benefit_names"), x["trigger"].alias("trigger"), x["amounts"].alias("amounts"))).alias("benefits"))
    c = table(spark, d, "contracts").join(b, ["product_name", "contract_name"], "left")
    one = F.struct(F.col("contract_name").alias("name"), F.col("contract_type").alias("type"), F.col("contract_code").alias("code"), "reference_amount", "source_pdf", F.coalesce("benefits", F.array().cast("array<struct<benefit_names:array<string>,trigger:string,amounts:array<struct<amount:string,condition:string,reduction_note:string>>>>")).alias("benefits"), "notes").cast(flatten.CONTRACT)
    g = c.select("insurer", "product_name", "contract_id", "contract_type", one.alias("c")).groupBy("insurer", "product_name").agg(
        F.min("contract_id").alias("ord"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("contract_type") == "main", F.struct("contract_id", "c")))), lambda x: x["c"]).alias("contracts"),
        F.array_sort(F.collect_list(F.when(F.col("contract_type") != "main", F.struct("contract_id", "c")))).alias("r"),
    )
    riders = F.transform("r", lambda x: F.struct(F.when(x["contract_id"] % 2 == 0, F.array(x["c"])).otherwise(F.array().cast(f"array<{flatten.CONTRACT}>")).alias("contracts"), x["c"].alias("contract")))
    return g.select("ord", "insurer", "product_name", "contracts", riders.alias("riders"))


def contracts_flat(spark, d):
    got = flatten.all_contracts(_products(spark, d))
    return got.select("product_name", F.col("c.name").alias("name"), X.text(F.col("c.code")).alias("code"), F.col("contract_ord").cast("long").alias("contract_ord"), F.size("c.benefits").cast("long").alias("n_benefits"))


def benefits_flat(spark, d):
    got = flatten.benefit_rows(flatten.all_contracts(_products(spark, d)))
    return got.select("product_name", "contract_name", BIG("benefit_ord"), BIG("name_ord"), "benefit_name", "trigger", F.size("amounts").cast("long").alias("n_amounts"))


def details_exported(spark, d):
    got = flatten.detail_rows(flatten.benefit_rows(flatten.all_contracts(_products(spark, d))))
    return got.select("product_name", "contract_name", BIG("benefit_ord"), BIG("amount_ord"), "amount", "amount_condition", "renewal_type", "coverage_limit", "dedupe_key", (F.col("amount_detail") != "").alias("several"))


def details_distinct(spark, d):
    order = ["product_ord", "contract_ord", "benefit_ord", "name_ord", "amount_ord"]
    got = flatten.distinct_details(flatten.detail_rows(flatten.benefit_rows(flatten.all_contracts(_products(spark, d)))), order)
    return got.select("dedupe_key", "product_name", "contract_name", "benefit_name")


def dedupe_keys(spark, d):
    return details(spark, d).select("row_id", flatten.dedupe_key().alias("new_key"), (flatten.dedupe_key() == X.text("dedupe_key")).alias("fresh"))


def catalog_all(spark, d):
    rows = details(spark, d).select("ord", "dedupe_key", *[c for c in flatten.KEY_FIELDS])
    halves = [rows.where(X.text("dedupe_key") == ""), rows]
    return catalog.load_all(*halves).select("dedupe_key", "ord", F.col("src").cast("long").alias("src"))


def catalog_upsert(spark, d):
    rows = details(spark, d).where(X.text("dedupe_key") != "").select("row_id", "dedupe_key", "artifact_id")
    late = table(spark, d, "artifacts").where("batch_no > 6").select("artifact_id")
    return catalog.upsert(rows.join(late, "artifact_id", "left_anti").select("row_id", "dedupe_key"), rows.join(late, "artifact_id", "left_semi").select("row_id", "dedupe_key"))


def unseen_artifacts(spark, d):
    a = table(spark, d, "artifacts")
    return catalog.unseen(a.where("batch_no > 6"), a.where("batch_no <= 6")).select("artifact_id", "batch_no")


def first_uploads(spark, d):
    return catalog.first_uploads(table(spark, d, "artifacts"), ["received_at", "artifact_id"]).select("artifact_id", "file_hash")


def fingerprints(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", catalog.fingerprint(F.encode("text", "UTF-8")).alias("short"), catalog.fingerprint(F.encode("text", "UTF-8"), None).alias("whole"))


def companies(spark, d):
    return catalog.companies(details(spark, d))


def context_rows(spark, d):
    return catalog.in_context(details(spark, d), OUR).select("row_id", "product_name", "benefit_name")


def product_choices(spark, d):
    return catalog.choices(details(spark, d), "product_name")


def dashboard_counts(spark, d):
    return catalog.counts(details(spark, d))


def column_fill(spark, d):
    return catalog.filled_columns(details(spark, d), ["trigger", "slots", "waiting_period", "exclusions", "terms_reference"])


def artifact_meta(spark, d):
    m = details(spark, d).where("insurer is not null").groupBy("insurer", "product_name").agg(F.count(F.lit(1)).alias("row_count"), F.min("row_id").alias("first_row"))
    return m.select("insurer", "product_name", "row_count", "first_row")


# --- comparison ------------------------------------------------------------------------------------------------------


def comparison_collapse(spark, d):
    got = collapse.comparison_rows(details(spark, d))
    return got.select("insurer", "product_name", "contract_name", "benefit_name", "renewal_type", "coverage_limit", "ord", "amount", "amount_condition", "trigger", F.size("triggers").cast("long").alias("n_triggers"), F.size("amounts").cast("long").alias("n_entries"), "detail_row_count")


def _sides(spark, d):
    rows = details(spark, d)
    return side(rows, OUR), side(rows, COMP)


def match_counts_by_key(spark, d):
    return matching.counts_by_key(*_sides(spark, d)).select("key", BIG("matched"), BIG("our_only"), BIG("comp_only"))


def match_summary(spark, d):
    return matching.match_counters(*_sides(spark, d))


def match_pairs(spark, d):
    return matching.paired(*_sides(spark, d))


def _tables(spark, d):
    return compare_sides(*_sides(spark, d))


def compared_pairs(spark, d):
    return _tables(spark, d)["pairs"].drop("our", "comp")


def slot_table(spark, d):
    return _tables(spark, d)["slots"]


def amount_table(spark, d):
    return _tables(spark, d)["amounts"]


def comparison_summary(spark, d):
    return _tables(spark, d)["summary"]


def coverage_by_disease(spark, d):
    return compare.coverage(matching.counts_by_key(*_sides(spark, d)))


def action_scores(spark, d):
    return _tables(spark, d)["scores"]


def action_margins(spark, d):
    return compare.by_margin(_tables(spark, d)["scores"]).select("action", BIG("margin"), BIG("place"))


def disease_order(spark, d):
    return compare.preferred_order(coverage_by_disease(spark, d), ["일반암", "고액암", "갑상선암"]).select("disease", BIG("place"))


def exclusive_actions(spark, d):
    return compare.exclusive_actions(matching.counts_by_key(*_sides(spark, d)))


def position(spark, d):
    return _tables(spark, d)["position"]


def top_gaps(spark, d):
    return _tables(spark, d)["gaps"]


def key_points(spark, d):
    return _tables(spark, d)["points"]


def deep_dive(spark, d):
    return _tables(spark, d)["facts"]


def slots_cached(spark, d):
    rows = details(spark, d)
    cache = rows.where("slots is not null").select("insurer", "benefit_name", "slots")
    return providers.with_cached_slots(rows.select("row_id", "insurer", "benefit_name", "slots"), cache).select("row_id", "slots")


def slots_enriched(spark, d):
    rows = details(spark, d).select("row_id", "insurer", "benefit_name", "trigger", "amount", "amount_condition", "slots")
    return providers.enrich(rows).select("row_id", "slots")


# --- report ----------------------------------------------------------------------------------------------------------


def _raw_sides(spark, d):
    rows = details(spark, d)
    return rows.where(F.col("insurer") == OUR), rows.where(F.col("insurer") == COMP)


def evidence(spark, d):
    return report.evidence(*_raw_sides(spark, d)).select("side", "ord", BIG("field_ord"), "field", "benefit", "value")


def evidence_numbers(spark, d):
    items = report.evidence(*_raw_sides(spark, d)).select("side", "side_ord", "ord", "field_ord", "field", "benefit", "value")
    return report.appendix(report.numbered(items, ["side_ord", "ord", "field_ord"])).select(BIG("evidence_no"), "side", "field", "benefit", "value")


def cancer_matrix(spark, d):
    return report.cancer_matrix(*_raw_sides(spark, d)).select("class", BIG("our_n"), BIG("comp_n"), "our_amounts", "comp_amounts")


def payment_matrix(spark, d):
    return report.payment_matrix(*_raw_sides(spark, d))


def names_alone(spark, d):
    return report.exclusives(*[s.where("benefit_name is not null") for s in _raw_sides(spark, d)])


def amounts_differ(spark, d):
    return report.differences(*[s.where("benefit_name is not null") for s in _raw_sides(spark, d)])


def report_lines(spark, d):
    our, comp = _sides(spark, d)
    t = compare_sides(our, comp)
    return report.markdown(t["pairs"], our, comp, t["points"])


def report_csv_rows(spark, d):
    return report.both_sides(*_raw_sides(spark, d)).select("side", "row_id", "benefit_name", "amount")


# --- layout ----------------------------------------------------------------------------------------------------------


def _printed(spark, d):
    """Rows as printed in a table per artifact: a name is printed once, above the rows it stands for."""
    w = Window.partitionBy("artifact_id").orderBy("row_id")
    rows = details(spark, d).where("artifact_id is not null")
    again = (X.text("benefit_name") == X.text(F.lag("benefit_name").over(w))) & (X.text("trigger") == X.text(F.lag("trigger").over(w))) & (F.row_number().over(w) > 1)
    return rows.select("artifact_id", "row_id", F.row_number().over(w).alias("n"), F.when(again, "").otherwise(X.text("benefit_name")).alias("name"), F.when(again, "").otherwise(X.text("trigger")).alias("cause"), X.text("amount").alias("sum"))


def _table_cells(spark, d):
    p = _printed(spark, d)
    body = p.select(F.col("artifact_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit(1).alias("table_no"), F.col("n").alias("row_no"), F.explode(F.array(*[F.struct(F.lit(i).alias("col_no"), F.col(c).alias("text")) for i, c in enumerate(("name", "cause", "sum"))])).alias("c")).select("doc_id", "page_idx", "table_no", "row_no", "c.*")
    head = p.select(F.col("artifact_id").alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("page_idx"), F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.explode(F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(t).alias("text")) for i, t in enumerate(("급 부 명 칭", "지급 사유", "지급\n금액"))])).alias("c")).select("doc_id", "page_idx", "table_no", "row_no", "c.*")
    return body.unionByName(head)


def table_benefits(spark, d):
    return layout.table_benefits(_table_cells(spark, d)).select("doc_id", BIG("benefit_no"), "name", "trigger", F.size("amounts").cast("long").alias("n_amounts"))


def table_quality(spark, d):
    return layout.quality(layout.valid_benefits(layout.table_benefits(_table_cells(spark, d))), ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


def _blocks(spark, d):
    p = _printed(spark, d)
    at = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(i).alias("k"), F.col(c).alias("text")) for i, (x, c) in enumerate(((50.0, "name"), (200.0, "cause"), (400.0, "sum")))])
    b = p.select(F.col("artifact_id").alias("doc_id"), F.floor((F.col("n") - 1) / 20).cast("int").alias("page_idx"), (((F.col("n") - 1) % 20) * 30 + 100).cast("double").alias("y"), "n", F.explode(at).alias("b"))
    return b.where("b.text <> ''").select("doc_id", "page_idx", (F.col("n") * 3 + F.col("b.k")).cast("long").alias("block_no"), F.col("b.x0").alias("x0"), (F.col("y") + F.col("b.k")).alias("y0"), F.col("b.text").alias("text"))


def reading_order(spark, d):
    return layout.reading_order(_blocks(spark, d)).select("doc_id", "block_no", BIG("ord"))


def row_islands(spark, d):
    return layout.row_islands(_blocks(spark, d)).select("doc_id", "block_no", BIG("group_no"))


def coordinate_benefits(spark, d):
    return layout.coordinate_benefits(_blocks(spark, d)).select("doc_id", BIG("group_no"), "name", "trigger", F.size("amounts").cast("long").alias("n_amounts"))


def best_reading(spark, d):
    t = layout.table_benefits(_table_cells(spark, d)).select("doc_id", "name", "trigger", "amounts")
    c = layout.coordinate_benefits(_blocks(spark, d)).select("doc_id", "name", "trigger", "amounts")
    return layout.better_reading(t, c, ["doc_id"]).select("doc_id", "name", F.size("amounts").cast("long").alias("n_amounts"))


def section_intervals(spark, d):
    b = _blocks(spark, d).where("x0 = 50").withColumn("text", F.concat(F.lit("□ 무배당 "), "text"))
    return layout.sections(b).select("doc_id", "name", BIG("start_page"), "start_y", BIG("end_page"), "end_y")


def first_marks(spark, d):
    return layout.first_mark(_blocks(spark, d), "진단").select("doc_id", BIG("page_idx"), "y0")


def _pages(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.lit(0).alias("page_idx"), F.concat(F.lit("주) "), "text").alias("text"))


def line_notes(spark, d):
    return layout.line_notes(_pages(spark, d)).select("doc_id", BIG("note_no"), "note")


def block_notes(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    b = docs.select("doc_id", F.lit(0).alias("page_idx"), F.posexplode(F.split(F.concat(F.lit("주)\n\n"), "text"), "\n\n")).alias("block_no", "text")).withColumns({"x0": F.lit(50.0), "y0": F.col("block_no").cast("double")})
    return layout.block_notes(b).select("doc_id", BIG("note_no"), "note")


def text_benefits(spark, d):
    return layout.text_benefits(_pages(spark, d)).select("doc_id", BIG("group_no"), "name", "amount")


def first_pages(spark, d):
    p = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page_idx", "text"))
    return layout.first_pages(p)


def component_riders(spark, d):
    c = table(spark, d, "contracts")
    page = c.groupBy("product_name").agg(F.concat(F.lit("주계약\n+ 주\n선택특약\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contract_id", "contract_name"))), lambda x: F.concat(F.lit("+ "), x["contract_name"])), "\n")).alias("text"))
    return layout.component_lines(page.select(F.col("product_name").alias("doc_id"), F.lit(0).alias("page_idx"), "text")).select("doc_id", "rider", BIG("line_no"))


def rider_cells(spark, d):
    cell = F.concat(F.lit("+ "), "contract_name", F.lit("\n+ "), "contract_name", F.lit("\n+ 주계")).alias("cell")
    return table(spark, d, "contracts").select("contract_id", cell).select("contract_id", F.posexplode(X.riders_of_cell("cell")).alias("pos", "rider")).select("contract_id", BIG("pos"), "rider")


def contract_headers(spark, d):
    c = table(spark, d, "contracts")
    page = F.concat(F.lit("1 / 9\n■ "), "contract_name", F.lit("("), F.coalesce("contract_code", F.lit("")), F.lit(") 무배당\n관리번호 "), F.col("contract_id").cast("string"), F.lit("\n무배당 "), "product_name", F.lit(" 상품 요약서\n(기준 : 특약가입금액 1,000만원)"))
    got = c.select("contract_id", page.alias("p")).select("contract_id", X.contract_header("p").alias("h"), X.management_no("p").alias("management_no"), X.product_name("p").alias("product"))
    return got.select("contract_id", F.col("h.name").alias("name"), F.col("h.code").alias("code"), F.col("h.reference_amount").alias("reference"), "management_no", "product")


def rider_directories(spark, d):
    c = table(spark, d, "contracts").select(F.col("contract_name").alias("name")).distinct()
    dirs = table(spark, d, "benefit_catalog").select(F.col("disease").alias("directory")).distinct()
    return layout.rider_directories(c, dirs)


def company_keys(spark, d):
    return table(spark, d, "contracts").select("contract_id", X.company_key(F.concat(F.lit(" "), "insurer", F.lit(" Life　"))).alias("key"))


def entry_query(spark, d):
    """Coverage of two insurers by disease: filter, collapse, key, match, count."""
    return coverage_by_disease(spark, d)


_NOT_QUERIES = {"details", "entry_query", "queries", "oracle_sql", "table", "side", "canonical_key", "is_raw", "key_action", "masked", "slot_label", "compare_sides"}


def queries():
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _NOT_QUERIES and k != "BIG"}


def oracle_sql():
    from coverline.oracles import sql

    return sql()
