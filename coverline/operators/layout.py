"""Tables and sections rebuilt from page layout: cells and text blocks with positions in, benefit rows and notes out.

Inputs are plain tables: ``cells(doc_id, page_idx, table_no, row_no, col_no, text)`` where a merged cell is null, and
``blocks(doc_id, page_idx, block_no, x0, y0, text)``. All stateful reading (carried-forward names, groups of lines,
sections) is window functions partitioned by document or table; a document is the largest unit one task orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions import amounts as A
from coverline.functions import text as X

TABLE = ("doc_id", "page_idx", "table_no")
#: Distances in points: columns, rows and header margin of the coordinate reading.
NAME_MAX, TRIGGER_MAX, ROW_GAP, HEADER_MARGIN, ENTRY_GAP = 130, 315, 40, 20, 5


def header_text(cells: Column) -> Column:
    """A header row as one string without letter spacing."""
    return X.clean(X.unspaced(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " ")))


def is_benefit_table(header: Column) -> Column:
    """Whether a header names benefit, cause and amount."""
    t = header_text(header)
    return t.contains("급부") & t.contains("사유") & t.contains("금액")


def column_roles(header: Column) -> Column:
    """T4: positions (benefit, trigger, amount, condition) of a header row; the last cell of a role counts, the condition may be a merged cell after the amount."""
    cells = F.transform(header, lambda c: X.clean(X.unspaced(c)))
    role = F.transform(cells, lambda h: F.when(h.contains("급부"), "benefit").when(h.contains("사유"), "trigger").when(h.contains("금액"), "amount").when(h.rlike("경과기간|조건"), "condition").otherwise(""))
    last = lambda r: F.array_max(F.transform(F.sequence(F.lit(0), F.size(role) - 1), lambda i: F.when(F.get(role, i) == r, i)))
    merged = F.array_max(F.transform(F.sequence(F.lit(0), F.size(role) - 1), lambda i: F.when((F.get(role, i) == "amount") & (i + 1 < F.size(header)) & F.get(header, i + 1).isNull(), i + 1)))
    condition = F.greatest(last("condition"), merged)
    return F.when(F.size(header) > 0, F.struct(F.coalesce(last("benefit"), F.lit(0)).alias("benefit"), F.coalesce(last("trigger"), F.lit(1)).alias("trigger"), F.coalesce(last("amount"), F.lit(2)).alias("amount"), condition.alias("condition")))


def rows_of(cells: DataFrame) -> DataFrame:
    """One row per table row with its cells as an ordered array (merged cells null)."""
    return cells.groupBy(*TABLE, "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]).alias("cells"))


def with_roles(rows: DataFrame) -> DataFrame:
    """Body rows of benefit tables with name, trigger, amount and condition; a second header row may carry the condition column."""
    t = Window.partitionBy(*TABLE)
    head = rows.withColumn("is_head", (F.col("row_no") < 3) & header_text(F.col("cells")).rlike("급부|사유"))
    head = head.withColumn("head_no", F.min(F.when(F.col("is_head"), F.col("row_no"))).over(t))
    head = head.withColumn("header", F.max(F.when(F.col("row_no") == F.col("head_no"), F.col("cells"))).over(t))
    head = head.withColumn("second", F.max(F.when(F.col("row_no") == F.col("head_no") + 1, F.col("cells"))).over(t))
    at = F.array_position(F.transform(F.coalesce("second", F.array().cast("array<string>")), lambda c: X.unspaced(c).contains("경과기간")), True) - 1
    body = head.where(is_benefit_table(F.col("header"))).withColumn("r", column_roles(F.col("header"))).withColumn("two", (at >= 0) & F.col("r.condition").isNull())
    cond = F.when(F.col("two"), at.cast("int")).otherwise(F.col("r.condition"))
    amount = F.when(F.col("two"), F.least(at + 1, F.size("header") - 1).cast("int")).otherwise(F.col("r.amount"))
    cell = lambda i: X.clean(F.get("cells", i))
    return body.where(F.col("row_no") > F.col("head_no") + F.col("two").cast("int")).select(*TABLE, "row_no", cell(F.col("r.benefit")).alias("name"), cell(F.col("r.trigger")).alias("trigger"), cell(amount).alias("amount"), F.when(cond.isNull(), "").otherwise(cell(cond)).alias("condition"))


def table_benefits(cells: DataFrame, trigger_opens: bool = True) -> DataFrame:
    """benefits of tables. A named row opens a benefit; a nameless row adds its amounts to the one before, or, with
    ``trigger_opens``, opens another of the same name if it has a trigger of its own. Names and triggers are carried forward."""
    rows = with_roles(rows_of(cells))
    seq = Window.partitionBy(*TABLE).orderBy("row_no")
    upto = seq.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("name") != "") | ((F.col("trigger") != "") if trigger_opens else F.lit(False))
    each = rows.withColumns({
        "benefit_no": F.sum(opens.cast("int")).over(upto), "full_name": F.last(F.nullif("name", F.lit("")), True).over(upto), "full_trigger": F.last(F.nullif("trigger", F.lit("")), True).over(upto),
        "entries": F.when(F.col("condition") != "", F.transform(A.cell_amounts("amount"), lambda e: F.struct(F.coalesce(F.nullif(e["condition"], F.lit("")), F.col("condition")).alias("condition"), e["amount"].alias("amount"), e["reduction_note"].alias("reduction_note")))).otherwise(A.cell_amounts("amount")),
    }).where("benefit_no > 0")
    got = each.groupBy(*TABLE, "benefit_no").agg(F.min_by(F.struct("full_name", "full_trigger"), "row_no").alias("f"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "entries"))), lambda x: x["entries"])).alias("amounts"))
    return got.select(*TABLE, "benefit_no", X.text(F.col("f.full_name")).alias("name"), X.text(F.col("f.full_trigger")).alias("trigger"), "amounts")


def valid_benefits(benefits: DataFrame) -> DataFrame:
    """Without header text, note marks or boilerplate taken for a benefit."""
    bad = F.col("name").rlike(r"(?U)^■|^주\s*\)|급\s*부\s*명|지\s*급\s*사\s*유|지\s*급\s*금\s*액")
    return benefits.where((F.col("name") != "") & ~bad & ~(F.col("name").startswith("보험기간 중 피보험자") & (F.size("amounts") == 0)))


def quality(benefits: DataFrame, section: list[str]) -> DataFrame:
    """Score of a section's benefits: some 0.3, all named 0.3 more, half with a first amount 0.4 more."""
    first = X.text(F.try_element_at("amounts", F.lit(1))["amount"]) != ""
    n = benefits.groupBy(*section).agg(F.bool_and(F.col("name") != "").alias("named"), F.avg(first.cast("int")).alias("share"))
    return n.select(*section, (F.lit(0.3) + F.when(F.col("named"), 0.3).otherwise(0.0) + F.when(F.col("share") >= 0.5, 0.4).otherwise(0.0)).alias("score"))


def better_reading(tables: DataFrame, coordinates: DataFrame, section: list[str], enough: float = 0.5) -> DataFrame:
    """P10, F8: per section the table reading if good enough, else the coordinate reading unless it is worse."""
    a, b = quality(tables, section).withColumnRenamed("score", "a"), quality(coordinates, section).withColumnRenamed("score", "b")
    pick = a.join(b, section, "full").select(*section, F.when((F.coalesce("a", F.lit(0.0)) >= enough) | (F.coalesce("b", F.lit(0.0)) < F.coalesce("a", F.lit(0.0))), "tables").otherwise("coordinates").alias("reading"))
    return tables.join(pick.where("reading = 'tables'").drop("reading"), section, "left_semi").unionByName(coordinates.join(pick.where("reading = 'coordinates'").drop("reading"), section, "left_semi"), allowMissingColumns=True)


def reading_order(blocks: DataFrame) -> DataFrame:
    """non-blank blocks with their place: by page, five-point line and x."""
    line = F.bround(F.col("y0") / ENTRY_GAP, 0) * ENTRY_GAP
    w = Window.partitionBy("doc_id").orderBy("page_idx", line, "x0", "block_no")
    return blocks.where(X.strip(X.text("text")) != "").withColumn("ord", F.row_number().over(w))


def column_of(x0: Column) -> Column:
    """Column of a block by its left edge."""
    return F.when(x0 < NAME_MAX, "name").when(x0 < TRIGGER_MAX, "trigger").otherwise("amount")


def row_islands(blocks: DataFrame) -> DataFrame:
    """Name blocks grouped into rows: a new row where the page changes or the gap exceeds the threshold."""
    w = Window.partitionBy("doc_id").orderBy("page_idx", "y0", "x0", "block_no")
    new = F.lag("page_idx").over(w).isNull() | (F.lag("page_idx").over(w) != F.col("page_idx")) | (F.col("y0") - F.lag("y0").over(w) > ROW_GAP)
    names = blocks.where(column_of(F.col("x0")) == "name").withColumn("new", new.cast("int"))
    return names.withColumn("group_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def coordinate_benefits(blocks: DataFrame) -> DataFrame:
    """Benefits by position: each row of names owns the trigger and amount blocks from its start to the next row's start.
    The interval is found by carrying the row number along the page order, so no range join is needed."""
    body = blocks.where(~X.clean("text").rlike(r"(?U)급\s*부\s*명|지\s*급\s*사\s*유|지\s*급\s*금\s*액"))
    starts = row_islands(body).groupBy("doc_id", "group_no").agg(F.min(F.struct("page_idx", "y0")).alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "y0", "x0", "block_no", "text"))), lambda b: X.clean(b["text"])), " ").alias("name"))
    marks = starts.select("doc_id", F.col("s.page_idx").alias("page_idx"), F.col("s.y0").alias("y0"), F.lit(-1.0).alias("x0"), F.lit(-1).cast("long").alias("block_no"), F.lit(None).cast("string").alias("text"), "group_no")
    others = body.where(column_of(F.col("x0")) != "name").select("doc_id", "page_idx", "y0", "x0", F.col("block_no").cast("long").alias("block_no"), "text", F.lit(None).cast("long").alias("group_no"))
    w = Window.partitionBy("doc_id").orderBy("page_idx", "y0", "x0", "block_no")
    placed = marks.withColumn("group_no", F.col("group_no").cast("long")).unionByName(others).withColumn("group_no", F.last("group_no", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("text is not null and group_no is not null")
    texts = lambda col: F.transform(F.array_sort(F.collect_list(F.when(column_of(F.col("x0")) == col, F.struct("page_idx", "y0", "x0", "block_no", "text")))), lambda b: b["text"])
    got = placed.groupBy("doc_id", "group_no").agg(texts("trigger").alias("t"), texts("amount").alias("a"))
    full = starts.withColumn("group_no", F.col("group_no").cast("long")).join(got, ["doc_id", "group_no"], "left")
    empty = F.array().cast("array<string>")
    return full.select("doc_id", "group_no", "name", X.clean(F.array_join(F.coalesce("t", empty), " ")).alias("trigger"), A.folded_amounts(F.coalesce("a", empty)).alias("amounts"))


def sections(blocks: DataFrame, marker: str = r"(?U)□\s+무배당") -> DataFrame:
    """sections by their marker line, each up to the next or the end of the document."""
    w = Window.partitionBy("doc_id").orderBy("page_idx", "y0", "x0", "block_no")
    name = X.strip(F.regexp_replace(F.regexp_replace(X.clean("text"), r"(?U)^□\s*", ""), r"(?U)\s*\((?:의무부가특약|선택특약)\)\s*$", ""))
    found = blocks.where(F.col("text").rlike(marker))
    end = F.coalesce(F.lead(F.struct("page_idx", "y0")).over(w), F.struct(F.lit(2**31 - 1).alias("page_idx"), F.lit(9999.0).alias("y0")))
    return found.select("doc_id", name.alias("name"), F.col("page_idx").alias("start_page"), F.col("y0").alias("start_y"), end.alias("e")).select("doc_id", "name", "start_page", "start_y", F.col("e.page_idx").alias("end_page"), F.col("e.y0").alias("end_y"))


def first_mark(blocks: DataFrame, pattern: str) -> DataFrame:
    """place of the first block of each document that matches, else the end of its last page."""
    place = F.coalesce(F.min(F.when(F.col("text").rlike(pattern), F.struct("page_idx", "y0"))), F.struct(F.max("page_idx").alias("page_idx"), F.lit(9999.0).alias("y0")))
    return blocks.groupBy("doc_id").agg(place.alias("p")).select("doc_id", F.col("p.page_idx").alias("page_idx"), F.col("p.y0").alias("y0"))


NEXT_TABLE = r"(?U)급\s*부\s*명.{0,10}지\s*급\s*사\s*유|지\s*급\s*사\s*유.{0,10}지\s*급\s*금\s*액|\[기준\s*[:：]|-\s*\d+\s*형|[◆①]\s*보험금\s*지급사유"


def block_notes(blocks: DataFrame) -> DataFrame:
    """Numbered notes after the note mark up to the next table, across pages; control-number lines are left out."""
    w = Window.partitionBy("doc_id").orderBy("page_idx", "y0", "x0", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    t = X.clean("text")
    b = blocks.where((t != "") & ~t.rlike(r"(?U)^관리번호")).withColumn("mark", t.rlike(r"(?U)^주\s*\)"))
    b = b.withColumn("inside", F.max(F.col("mark").cast("int")).over(w))
    b = b.withColumn("stop", F.max(((F.col("inside") == 1) & ~F.col("mark") & t.rlike(NEXT_TABLE)).cast("int")).over(w)).where("inside = 1 and stop = 0")
    piece = F.when(F.col("mark"), X.strip(F.regexp_replace(F.col("text"), r"(?U)^\s*주\s*\)\s*", ""))).otherwise(F.col("text"))
    joined = b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "y0", "x0", "block_no", piece.alias("t")))), lambda x: F.nullif(x["t"], F.lit(""))), "\n").alias("t"))
    return joined.select("doc_id", F.posexplode(X.numbered_notes(X.note_text("t"))).alias("note_no", "note"))


def line_notes(pages: DataFrame) -> DataFrame:
    """Notes of page text by line: a number opens a note, other lines go on with it; page numbers and very short notes are dropped."""
    lines = pages.select("doc_id", "page_idx", F.posexplode(F.split(X.text("text"), "\n")).alias("line_no", "line")).withColumn("line", X.strip(F.col("line")))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^\s*\d+\s*/\s*\d+\s*$"))
    w = Window.partitionBy("doc_id", "page_idx").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("line").rlike(r"(?U)^주\s*\)")
    rest = X.strip(F.regexp_replace(F.col("line"), r"(?U)^주\s*\)\s*", ""))
    each = lines.withColumns({"inside": F.max(mark.cast("int")).over(w), "content": F.when(mark, rest).otherwise(F.col("line"))}).where("inside = 1 and content <> ''")
    opens = mark | F.col("line").rlike(r"(?U)^\d{1,2}\.\s")
    each = each.withColumn("note_no", F.sum(opens.cast("int")).over(w)).where("note_no > 0")
    notes = each.groupBy("doc_id", "page_idx", "note_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), " ").alias("note"))
    return notes.where(F.length("note") > 5)


def text_benefits(pages: DataFrame) -> DataFrame:
    """benefits of page text without tables: lines up to one with an amount are a benefit: its first line the name, the others the trigger."""
    amount = r"(?U)\d[\d,]*\s*만?\s*원|\d+회당|\d+%"
    lines = pages.select("doc_id", "page_idx", F.posexplode(F.split(X.text("text"), "\n")).alias("line_no", "line")).withColumn("line", X.strip(F.col("line")))
    hit = F.col("line").rlike(amount)
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^\s*\d+\s*/\s*\d+\s*$") & (hit | (F.length("line") > 3)))
    w = Window.partitionBy("doc_id", "page_idx").orderBy("line_no")
    each = lines.withColumn("group_no", F.coalesce(F.sum(hit.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = each.groupBy("doc_id", "page_idx", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.when(~hit, F.struct("line_no", "line")))), lambda x: x["line"]).alias("buffer"), F.max(F.when(hit, F.col("line"))).alias("amount"))
    done = got.where((F.size("buffer") > 0) & F.col("amount").isNotNull())
    return done.select("doc_id", "page_idx", "group_no", F.try_element_at("buffer", F.lit(1)).alias("name"), F.array_join(F.slice("buffer", F.lit(2), F.size("buffer")), " ").alias("trigger"), "amount")


def first_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """Text of the first pages of every document."""
    few = pages.where(F.col("page_idx") < n).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", X.text("text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return few


def component_lines(pages: DataFrame, last_page: int = 25, from_page: int = 7) -> DataFrame:
    """Riders of the composition pages: lines after a rider heading that start with "+", up to the first benefit table after page 7; the mode is carried forward."""
    lines = pages.where(F.col("page_idx") < last_page).select("doc_id", "page_idx", F.posexplode(F.split(X.text("text"), "\n")).alias("line_no", "line")).withColumn("line", X.strip(F.col("line"))).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("page_idx", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    mode = F.when(F.col("line").rlike(r"(?U)^주\s*계\s*약"), "main").when(F.col("line").rlike(r"(?U)^(?:선택\s*특약|부가\s*특약)"), "rider")
    stop = (F.col("page_idx") >= from_page) & F.col("line").contains("급부") & F.col("line").contains("사유") & F.col("line").contains("금액")
    each = lines.withColumns({"mode": F.last(mode, True).over(w), "stop": F.max(stop.cast("int")).over(w)}).where((F.col("mode") == "rider") & (F.col("stop") == 0) & F.col("line").startswith("+"))
    named = each.withColumn("rider", X.strip(F.regexp_replace(F.col("line"), r"^[+ ]+", ""))).where("rider <> ''")
    return named.groupBy("doc_id", "rider").agg(F.min(F.struct("page_idx", "line_no")).alias("at")).select("doc_id", "rider", F.col("at.page_idx").alias("page_idx"), F.col("at.line_no").alias("line_no"))


def contract_pages(pages: DataFrame) -> DataFrame:
    """One contract per page with a header, the first page of each full name."""
    from coverline.operators.flatten import first_per

    headed = pages.withColumn("h", X.contract_header("text")).where("h is not null").select("doc_id", "page_idx", "h.*")
    return first_per(headed, ["doc_id", "full_name"], ["page_idx"])


def rider_directories(names: DataFrame, directories: DataFrame) -> DataFrame:
    """The directory of a rider: equal without blanks, else one name inside the other. Equality is a hash join; only
    names it leaves over meet the directories by containment, of which there is a bounded listing."""
    from coverline.session import bounded

    n = names.withColumn("k", X.squeeze("name")).where("k <> ''")
    d = directories.withColumn("k2", X.squeeze("directory")).where("k2 <> ''")
    same = n.join(d, F.col("k") == F.col("k2")).groupBy("name").agg(F.min("directory").alias("directory"))
    left = n.join(same, "name", "left_anti")
    inside = left.join(bounded(d), F.col("k").contains(F.col("k2")) | F.col("k2").contains(F.col("k"))).groupBy("name").agg(F.min("directory").alias("directory"))
    return same.unionByName(inside)
