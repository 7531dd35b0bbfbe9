"""Matched benefits compared slot by slot, and the tables and counts made of the outcome.

``RULES`` says how each slot is read; every verdict is one expression, so a whole comparison is a projection over the
pairs. Verdicts are the words the reports print.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions import amounts as A
from coverline.functions import fixed
from coverline.functions.lexicon import DEFAULT, Lexicon, key_action
from coverline.functions.text import squeeze, strip, text

# Slots in order as (name, way of comparing, label), and the raw column of each.
RULES = [("amount_display", "numeric", "금액"), ("payment_freq", "display_only", "지급조건"), ("payment_limit", "limit_numeric", "지급한도"), ("reduction_rule", "none_is_better", "감액조건"), ("start_condition", "display_only", "보장개시"), ("trigger", "display_only", "지급사유")]
RAW = {"trigger": "trigger", "start_condition": "waiting_period", "payment_freq": "amount_condition", "payment_limit": "coverage_limit", "reduction_rule": "reduction_note"}
# Verdicts.
OURS, THEIRS, SAME, DIFFERS, UNKNOWN, SHOWN, ONLY_OURS, ONLY_THEIRS = "당사우위", "타사우위", "동일", "조건상이", "비교불가", "표시", "당사단독", "타사단독"


def _larger(a: Column, b: Column, higher: bool = True) -> Column:
    return F.when(a == b, SAME).when((a > b) if higher else (a < b), OURS).otherwise(THEIRS)


def slot_verdict(kind: str, our, comp, higher: bool = True, ranks: list[str] | None = None) -> Column:
    """Verdict on one slot: numeric, limit_numeric, rank, none_is_better or display_only."""
    a, b = text(our), text(comp)
    none = F.when((a == "") & (b == ""), UNKNOWN)
    if kind in ("numeric", "limit_numeric"):
        none = none.when(a == "", THEIRS).when(b == "", OURS)
    elif kind != "none_is_better":
        none = none.when((a == "") | (b == ""), UNKNOWN)
    if kind in ("numeric", "rank"):
        x, y = (A.won(a), A.won(b)) if kind == "numeric" else (A.rank(a, ranks or []), A.rank(b, ranks or []))
        return none.when(x.isNull() | y.isNull(), F.when(strip(a) == strip(b), SAME).otherwise(UNKNOWN)).otherwise(_larger(x, y, higher))
    if kind == "limit_numeric":
        x, y = A.limit(a), A.limit(b)
        return none.when(x.isNull() | y.isNull(), F.when(squeeze(a) == squeeze(b), SAME).otherwise(UNKNOWN)).when(x["unit"] != y["unit"], UNKNOWN).otherwise(_larger(x["n"], y["n"], higher))
    if kind == "none_is_better":
        x, y = A.won(a), A.won(b)
        both = F.when(x.isNotNull() & y.isNotNull(), _larger(x, y, False)).otherwise(F.when(squeeze(a) == squeeze(b), SAME).otherwise(UNKNOWN))
        return none.when(A.absent(a) & A.absent(b), SAME).when(A.absent(a), OURS).when(A.absent(b), THEIRS).otherwise(both)
    return none.when(squeeze(a) == squeeze(b), SAME).otherwise(SHOWN)


def amount_verdict(our: Column, comp: Column) -> Column:
    """(advantage, rationale) of two amount infos: the greater wins; of equal ones the unconditional."""
    a, b = our["value"], comp["value"]
    shown = lambda i: F.when(i["conditional"] & (i["note"] != ""), F.concat(F.lit("("), i["note"], F.lit(")"))).otherwise("")
    most = lambda side, i: F.when(i["conditional"], F.concat(F.lit(f" · {side}최대"), A.manwon(i["value"]), shown(i))).otherwise("")
    out = lambda adv, why: F.struct(F.lit(adv).alias("advantage"), (F.lit(why) if isinstance(why, str) else why).alias("rationale"))
    return (
        F.when(a.isNull() & b.isNull(), out(UNKNOWN, "")).when(a.isNull(), out(THEIRS, "금액↓")).when(b.isNull(), out(OURS, "금액↑"))
        .when(a > b, out(OURS, F.concat(F.lit("금액↑"), most("타사", comp)))).when(a < b, out(THEIRS, F.concat(F.lit("금액↓"), most("당사", our))))
        .when(our["conditional"] & comp["conditional"], F.when(our["note"] != comp["note"], out(DIFFERS, F.concat(F.lit("당사"), shown(our), F.lit(" / 타사"), shown(comp)))).otherwise(out(SAME, "")))
        .when(our["conditional"], out(THEIRS, F.concat(F.lit("조건없음 (당사"), shown(our), F.lit(")"))))
        .when(comp["conditional"], out(OURS, F.concat(F.lit("조건없음 (타사"), shown(comp), F.lit(")")))).otherwise(out(SAME, ""))
    )


def slot_value(row: str, slot: str) -> Column:
    """Value of a slot: from the filled-in slots if there, else from its raw column."""
    raw = text(F.col(f"{row}.{RAW[slot]}")) if slot in RAW else F.lit("")
    filled = F.when(F.ltrim(text(F.col(f"{row}.slots"))).startswith("{"), F.get_json_object(F.col(f"{row}.slots"), f"$.{slot}"))
    if slot == "amount_display":
        raw = A.display(F.col(f"{row}.amount"), F.col(f"{row}.amount_condition"), F.col(f"{row}.amounts"))
    return F.coalesce(F.nullif(filled, F.lit("")), raw, F.lit(""))


SIDE = ("ord", "benefit_name", "amount", "amount_condition", "reduction_note", "waiting_period", "coverage_limit", "trigger", "slots", "amounts")


def compared(pairs: DataFrame, our: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs with both rows, displayed amounts, verdict and rationale. Sides are joined by order number."""
    side = lambda df, name: df.select(F.col("ord").alias(f"{name}_ord"), F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in SIDE]).alias(name))
    both = pairs.join(side(our, "our"), "our_ord", "left").join(side(comp, "comp"), "comp_ord", "left")
    info = lambda r: A.info(F.col(f"{r}.amount"), F.col(f"{r}.amount_condition"), F.coalesce(F.col(f"{r}.amounts"), F.array().cast("array<struct<amount:string,condition:string,reduction_note:string,trigger:string>>")))
    verdict = F.when(F.col("match_type") == "our_only", F.struct(F.lit(ONLY_OURS).alias("advantage"), F.lit("").alias("rationale"))).when(F.col("match_type") == "comp_only", F.struct(F.lit(ONLY_THEIRS).alias("advantage"), F.lit("").alias("rationale"))).otherwise(amount_verdict(F.col("ai"), F.col("bi")))
    show = lambda r: F.when(F.col(f"{r}_ord").isNull(), "").otherwise(slot_value(r, "amount_display"))
    both = both.withColumns({"ai": info("our"), "bi": info("comp"), "our_shown": show("our"), "comp_shown": show("comp")}).withColumn("v", verdict)
    return both.select("key", "match_type", "our_ord", "comp_ord", text(F.col("our.benefit_name")).alias("our_name"), text(F.col("comp.benefit_name")).alias("comp_name"), F.col("our_shown").alias("our_amount"), F.col("comp_shown").alias("comp_amount"), F.col("v.advantage").alias("advantage"), F.col("v.rationale").alias("rationale"), "our", "comp")


def slot_table(pairs: DataFrame, rules=RULES) -> DataFrame:
    """Matched pairs by slot: both values and the verdict; the amount slot has the pair's own verdict."""
    rows = []
    for i, (slot, kind, label) in enumerate(rules):
        a, b = slot_value("our", slot), slot_value("comp", slot)
        rows.append(F.struct(F.lit(i).alias("slot_ord"), F.lit(slot).alias("dimension"), F.lit(label).alias("label"), a.alias("our_value"), b.alias("comp_value"), (F.col("advantage") if slot == "amount_display" else slot_verdict(kind, a, b)).alias("advantage")))
    return pairs.where("match_type = 'matched'").select("key", "our_ord", "comp_ord", "our_name", "comp_name", F.explode(F.array(*rows)).alias("s")).select("key", "our_ord", "comp_ord", "our_name", "comp_name", "s.*")


def amount_table(pairs: DataFrame) -> DataFrame:
    """Matched pairs, then ours alone, then theirs alone; what a side lacks is a dash."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    section = F.when(F.col("match_type") == "matched", 0).when(F.col("match_type") == "our_only", 1).otherwise(2)
    return pairs.select(section.alias("section"), "key", "our_ord", "comp_ord", dash("our_name").alias("our_name"), dash("comp_name").alias("comp_name"), dash("our_amount").alias("our_amount"), dash("comp_amount").alias("comp_amount"), "advantage", "rationale")


def summary(pairs: DataFrame) -> DataFrame:
    """A4: numbers of matched, single and differing pairs."""
    n = lambda cond: F.count_if(cond).cast("long")
    m = F.col("match_type")
    differing = F.col("advantage").isin(OURS, THEIRS, DIFFERS, UNKNOWN) & (m == "matched")
    return pairs.agg(n(m == "matched").alias("matched"), n(m == "our_only").alias("our_only"), n(m == "comp_only").alias("comp_only"), n(differing).alias("diff"), F.count(F.lit(1)).alias("total"))


def counted(pairs: DataFrame) -> DataFrame:
    """Matched, our_only and comp_only by key of a frame of pairs (the same as ``matching.counts_by_key`` of its sides)."""
    n = lambda kind: F.count_if(F.col("match_type") == kind).cast("long").alias(kind)
    return pairs.groupBy("key").agg(n("matched"), n("our_only"), n("comp_only"))


def coverage(counts: DataFrame, lexicon: Lexicon = DEFAULT, composite: dict = fixed.COMPOSITE, more: list[str] = fixed.MORE_COVERED) -> DataFrame:
    """A5: benefits by disease from the counts by key: ours, theirs, matched pairs (``matched`` counts both sides of a pair). A composite label counts for each of its diseases."""
    labels = list(dict.fromkeys([*lexicon.labels("disease"), *more, *composite]))
    first = F.try_element_at(F.filter(F.split("key", r"\|"), lambda p: p.isin(labels)), F.lit(1))
    diseases = F.when(first.isNull(), F.array(F.lit("기타")))
    for label, parts in composite.items():
        diseases = diseases.when(first == label, F.array(*map(F.lit, parts)))
    each = counts.select("matched", "our_only", "comp_only", F.explode(diseases.otherwise(F.array(first))).alias("disease"))
    total = lambda c: F.sum(c).cast("long")
    return each.groupBy("disease").agg(total(F.col("matched") + F.col("our_only")).alias("our"), total(F.col("matched") + F.col("comp_only")).alias("comp"), total("matched").alias("matched_pairs"), (total("matched") * 2).alias("matched"))


def action_scores(pairs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Wins, losses and rest of matched pairs by kind of benefit."""
    action = F.coalesce(F.nullif(key_action(F.col("key"), lexicon), F.lit("")), F.lit("기타"))
    n = lambda cond: F.count_if(cond).cast("long")
    adv = F.col("advantage")
    return pairs.where("match_type = 'matched'").groupBy(action.alias("action")).agg(n(adv == OURS).alias("win"), n(adv == THEIRS).alias("lose"), n(~adv.isin(OURS, THEIRS)).alias("rest"))


def by_margin(scores: DataFrame) -> DataFrame:
    """Kinds of benefit by wins minus losses (a table of labels, so one ordering is enough)."""
    m = scores.withColumn("margin", F.col("win") - F.col("lose"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.col("margin").desc(), "action")))


def preferred_order(coverage_table: DataFrame, first: list[str]) -> DataFrame:
    """Diseases in display order: the listed ones first, the rest by name, what has no disease left out."""
    listed = F.array(*map(F.lit, first))
    at = F.nullif(F.array_position(listed, F.col("disease")), F.lit(0).cast("long"))
    shown = coverage_table.where("disease <> '기타'").withColumn("at", F.coalesce(at, F.lit(len(first) + 1)))
    return shown.withColumn("place", F.row_number().over(Window.orderBy("at", "disease"))).drop("at")


def exclusive_actions(counts: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Benefits only one side has, by side and kind of benefit, from the counts by key."""
    action = F.coalesce(F.nullif(key_action(F.col("key"), lexicon), F.lit("")), F.lit("기타"))
    sides = F.array(F.struct(F.lit("our").alias("side"), F.col("our_only").alias("n")), F.struct(F.lit("comp").alias("side"), F.col("comp_only").alias("n")))
    each = counts.select(action.alias("action"), F.explode(sides).alias("s")).where("s.n > 0")
    return each.groupBy("s.side", "action").agg(F.sum("s.n").cast("long").alias("n"))


def position(pairs: DataFrame) -> DataFrame:
    """Position of our product by the half rule, shares in whole percent, and the headline."""
    n = lambda cond: F.count_if(cond).cast("long")
    m, adv = F.col("match_type") == "matched", F.col("advantage")
    t = pairs.agg(n(m).alias("matched"), n(m & (adv == OURS)).alias("our_adv"), n(m & (adv == THEIRS)).alias("comp_adv"), n(m & (adv == SAME)).alias("equal"), n(m & (adv == DIFFERS)).alias("cond_diff"), n(F.col("match_type") == "our_only").alias("our_only"), n(F.col("match_type") == "comp_only").alias("comp_only"))
    share = lambda c: F.when(F.col("matched") == 0, F.lit(0.0)).otherwise(F.col(c) * 100.0 / F.col("matched"))
    place = F.when(F.col("matched") == 0, "단독보장중심").when((F.col("our_adv") > F.col("comp_adv")) & (share("our_adv") >= 50), "우위").when((F.col("comp_adv") > F.col("our_adv")) & (share("comp_adv") >= 50), "열위").otherwise("혼재")
    t = t.withColumns({"position": place, "our_share": F.bround(share("our_adv"), 0).cast("long"), "comp_share": F.bround(share("comp_adv"), 0).cast("long")})
    alone = F.concat(F.when(F.col("our_only") > 0, F.format_string(" · 당사 단독 %d건", "our_only")).otherwise(""), F.when(F.col("comp_only") > 0, F.format_string(" · 타사 단독 %d건", "comp_only")).otherwise(""))
    head = F.when(F.col("matched") == 0, F.format_string("매칭 급부 없음 — 당사 %d건 단독 / 타사 %d건 단독", "our_only", "comp_only")).otherwise(F.concat(F.format_string("매칭 %d건 중 당사우위 %d건(%d%%) / 타사우위 %d건(%d%%)", "matched", "our_adv", "our_share", "comp_adv", "comp_share"), alone))
    return t.withColumn("headline", head)


def top_gaps(pairs: DataFrame, k: int = 3) -> DataFrame:
    """O2: the k greatest differences of displayed amounts in percent of theirs (``max`` amounts: gap_from_max), in order."""
    a, b = A.won(F.col("our_amount")), A.won(F.col("comp_amount"))
    won = pairs.where((F.col("match_type") == "matched") & F.col("advantage").isin(OURS, THEIRS)).withColumns({"a": a, "b": b}).where("a > 0 and b > 0")
    gaps = won.select("our_ord", F.coalesce(F.nullif("our_name", F.lit("")), "comp_name").alias("name"), A.manwon(F.col("a")).alias("our_amt"), A.manwon(F.col("b")).alias("comp_amt"), F.bround((F.col("a") - F.col("b")) / F.col("b") * 100, 0).cast("long").alias("gap_pct"), F.col("advantage").alias("side"))
    return gaps.orderBy(F.abs("gap_pct").desc(), "our_ord").limit(k)


def slot_wins(slots: DataFrame) -> DataFrame:
    """By slot and winner: number and first example."""
    won = slots.where((F.col("dimension").isin("payment_limit", "reduction_rule")) & F.col("advantage").isin(OURS, THEIRS))
    return won.groupBy("dimension", "advantage").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("our_name", "our_value", "comp_value"), F.struct("our_ord", "comp_ord")).alias("e")).select("dimension", "advantage", "n", F.col("e.our_name").alias("name"), F.col("e.our_value").alias("our_value"), F.col("e.comp_value").alias("comp_value"))


def key_points(pairs: DataFrame, slots: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The ordered statements of the comparison as (ord, type, label, n, detail); statements without cases are left out."""
    p = position(pairs)
    gaps = top_gaps(pairs).groupBy("side").agg(F.max_by(F.format_string("%s (%s vs %s, %+d%%)", "name", "our_amt", "comp_amt", "gap_pct"), F.struct(F.abs("gap_pct"), -F.col("our_ord"))).alias("best"))
    best = gaps.groupBy(F.lit(1).alias("one")).agg(F.max(F.when(F.col("side") == OURS, F.col("best"))).alias("up"), F.max(F.when(F.col("side") == THEIRS, F.col("best"))).alias("down"))
    ex = exclusive_actions(counted(pairs), lexicon).groupBy("side").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "action", "n"))).alias("l"))
    cats = ex.groupBy(F.lit(1).alias("one")).agg(*[F.max(F.when(F.col("side") == s, F.array_join(F.transform(F.slice("l", F.lit(1), F.size("l") if k is None else F.lit(k)), lambda x: F.format_string("%s %d건", x["action"], x["n"])), " · "))).alias(s) for s, k in (("our", None), ("comp", 4))])
    w = slot_wins(slots).groupBy(F.lit(1).alias("one")).agg(*[F.coalesce(F.max(F.when((F.col("dimension") == d) & (F.col("advantage") == v), F.col("n"))), F.lit(0)).alias(a) for d, v, a in (("payment_limit", OURS, "lim_up"), ("payment_limit", THEIRS, "lim_down"), ("reduction_rule", OURS, "red_up"), ("reduction_rule", THEIRS, "red_down"))])
    t = p.withColumn("one", F.lit(1)).join(best, "one", "left").join(cats, "one", "left").join(w, "one", "left").na.fill(0, ["lim_up", "lim_down", "red_up", "red_down"])
    point = lambda o, kind, label, n, d: F.struct(F.lit(o).alias("ord"), F.lit(kind).alias("type"), F.lit(label).alias("label"), n.cast("long").alias("n"), F.coalesce(d, F.lit("")).alias("detail"))
    c = F.col
    points = F.array(point(1, "strength", "금액 우위", c("our_adv"), c("up")), point(2, "strength", "당사 단독 보장", c("our_only"), c("our")), point(3, "strength", "조건 우위", c("lim_up") + c("red_up"), F.format_string("지급한도 %d건 / 감액조건 %d건", "lim_up", "red_up")), point(4, "weakness", "금액 열위", c("comp_adv"), c("down")), point(5, "weakness", "조건 열위", c("lim_down") + c("red_down"), F.format_string("지급한도 %d건 / 감액조건 %d건", "lim_down", "red_down")), point(6, "gap", "보장 갭 (도입 검토)", c("comp_only"), c("comp")))
    return t.select(F.explode(F.filter(points, lambda x: x["n"] > 0)).alias("p")).select("p.*")


def deep_dive(pairs: DataFrame, top: int = 5) -> DataFrame:
    """Facts on both sides: benefits in all, alone, and the first names alone."""

    def side(s: str, kind: str) -> DataFrame:
        one = F.lit(1).alias("one")
        n = pairs.where(F.col("match_type").isin("matched", kind)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("match_type") == kind).cast("long").alias("alone")).select(one, "total", "alone")
        first = pairs.where(F.col("match_type") == kind).select(F.col(f"{s}_ord").alias("o"), F.col(f"{s}_name").alias("name")).orderBy("o").limit(top)
        names = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]), " / ").alias("names")).select(one, "names")
        return n.join(names, "one").select(F.lit(s).alias("side"), "total", "alone", "names")

    return side("our", "our_only").unionByName(side("comp", "comp_only"))
