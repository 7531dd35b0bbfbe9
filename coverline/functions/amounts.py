"""Amounts, limits and conditions as column expressions, in the plain reading the comparison uses (exact unit conversion: operators.units)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverline.functions import fixed
from coverline.functions.bind import let
from coverline.functions.text import clean, squeeze, strip, text

ENTRY = "struct<condition:string,amount:string,reduction_note:string>"
DETAIL = "array<struct<amount:string,condition:string,reduction_note:string,trigger:string>>"


def won(c) -> Column:
    """``N만원`` in won, else the first positive number as it stands, else null."""
    t = text(c)
    scaled = F.regexp_extract(t, r"(?U)([\d,]*\d[\d,]*)\s*만\s*원", 1)
    plain = F.regexp_extract(t, r"(?U),*(\d[\d,]*)", 1)
    number = lambda x: F.try_to_number(F.regexp_replace(x, ",", ""), F.lit("9" * 18)).cast("long")
    return F.coalesce(number(F.nullif(scaled, F.lit(""))) * 10000, F.nullif(number(F.nullif(plain, F.lit(""))), F.lit(0).cast("long")))


def limit(c) -> Column:
    """(unit, n) of a limit; times per year, first times and plain times are different units."""
    t = squeeze(c)
    n, unit = F.regexp_extract(t, r"(\d+)(?:년|회)", 1), F.regexp_extract(t, r"\d+(년|회)", 1)
    kind = F.when(unit == "년", "년").when(t.contains("최초"), "최초_회").when(t.contains("연간") | t.contains("매년"), "연간_회").otherwise("회")
    return F.when(unit != "", F.struct(kind.alias("unit"), n.cast("long").alias("n")))


def short_condition(c) -> Column:
    """The period of a condition without blanks, else its first fifteen characters."""
    t = strip(F.regexp_replace(text(c), r"(?U)\s+", " "))
    period = F.replace(F.regexp_extract(t, r"(?U)" + fixed.PERIOD_SHORT, 0), F.lit(" "), F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, 15), r"(?U)\s+$", ""), F.when(F.length(t) > 15, "…").otherwise(""))
    return F.when(period != "", F.regexp_replace(period, "(?<!이)후$", "이후")).otherwise(cut)


def cell_amounts(c) -> Column:
    """Entries (condition, amount, reduction_note) of an amount cell, by the first of five readings that applies."""
    t = clean(c)
    note = strip(F.regexp_extract(t, r"(?U)" + fixed.REDUCTION, 1))
    entry = lambda cond, amount, red: F.struct(cond.alias("condition"), amount.alias("amount"), red.alias("reduction_note"))
    by_year = F.regexp_extract_all(t, F.lit(r"(?U)" + fixed.YEAR_AMOUNT), F.lit(1))
    sums = F.regexp_extract_all(t, F.lit(r"(?U)" + fixed.YEAR_AMOUNT), F.lit(2))
    yearly = F.transform(F.arrays_zip(by_year.alias("c"), sums.alias("a")), lambda x, i: entry(clean(x["c"]), clean(x["a"]), F.when(i == F.size(by_year) - 1, note).otherwise("")))
    ratio = F.regexp_extract(t, r"(?U)" + fixed.RATIO, 0)
    at = F.locate(ratio, t) if isinstance(ratio, str) else F.instr(t, ratio)
    before, after = strip(F.substring(t, F.lit(1), at - 1)), strip(F.substring(t, at + F.length(ratio), F.length(t)))
    proviso = F.regexp_extract(after, r"(?U)\(단[,，]\s*.+?\)", 0)
    rest = F.when(proviso != "", clean(proviso)).otherwise(clean(F.substring(after, 1, 200)))
    rate = before.rlike("^(?:매월|매년|매회)")
    cond = F.when(rate, strip(F.concat_ws(" ", before, F.nullif(rest, F.lit(""))))).otherwise(rest)
    periodic = r"(?U)^(매월|매년\(매회\)|매년)\s*(\d[\d,]+만원)"
    plain = F.regexp_extract(t, r"(?U)" + fixed.AMOUNT, 0)
    one = F.when(ratio != "", entry(cond, F.regexp_replace(clean(ratio), r"(?U)\s+의\s*", "의 "), note))
    one = one.when(t.rlike(periodic), entry(F.regexp_extract(t, periodic, 1), F.regexp_extract(t, periodic, 2), note))
    one = one.when(plain != "", entry(F.lit(""), clean(plain), note)).otherwise(entry(t, F.lit(""), F.lit("")))
    return F.when(t == "", F.array().cast(f"array<{ENTRY}>")).when(F.size(by_year) > 0, yearly.cast(f"array<{ENTRY}>")).otherwise(F.array(one).cast(f"array<{ENTRY}>"))


def folded_amounts(texts: Column) -> Column:
    """Entries of a list of amount blocks: text without an amount is the condition of the next, a proviso belongs to the last."""
    start = F.struct(F.array().cast(f"array<{ENTRY}>").alias("done"), F.lit("").alias("pending"))

    def step(acc, raw):
        t = clean(raw)
        amount = F.regexp_extract(t, r"(?U)" + fixed.AMOUNT, 0)
        pre = strip(F.substring(t, F.lit(1), F.instr(t, amount) - 1))
        cond = clean(F.concat_ws(" ", acc["pending"], pre))
        new = F.struct(cond.alias("condition"), clean(amount).alias("amount"), clean(F.regexp_extract(t, r"(?U)" + fixed.REDUCTION, 1)).alias("reduction_note"))
        last = F.try_element_at(acc["done"], F.lit(-1))
        fixed_last = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), F.array(F.struct(last["condition"].alias("condition"), last["amount"].alias("amount"), t.alias("reduction_note"))))
        return (
            F.when(t == "", acc)
            .when(amount != "", F.struct(F.concat(acc["done"], F.array(new)).alias("done"), F.lit("").alias("pending")))
            .when(t.rlike(r"^\(단[,，]") & (F.size(acc["done"]) > 0), F.struct(fixed_last.alias("done"), acc["pending"].alias("pending")))
            .otherwise(F.struct(acc["done"].alias("done"), clean(F.concat_ws(" ", acc["pending"], t)).alias("pending")))
        )

    return F.aggregate(texts, start, step, lambda acc: acc["done"])


def detail(c) -> Column:
    """Amount entries of a JSON list; anything else gives an empty list."""
    return F.when(F.ltrim(text(c)).startswith("["), F.coalesce(F.from_json(c, DETAIL), F.array().cast(DETAIL))).otherwise(F.array().cast(DETAIL))


def manwon(v: Column) -> Column:
    """A sum in units of ten thousand won with thousands separators."""
    return F.concat(F.format_number(F.floor(v / 10000), 0), F.lit("만원"))


def display(amount, condition, entries: Column) -> Column:
    """Amounts by short condition (least to greatest), in order of first appearance; without entries the plain amount."""
    keyed = F.filter(F.transform(entries, lambda e: F.struct(F.when(text(e["condition"]) != "", short_condition(e["condition"])).otherwise("").alias("k"), won(e["amount"]).alias("v"))), lambda x: x["v"].isNotNull())

    def line(k, values):
        def show(vals):
            lo, hi = F.array_min(vals), F.array_max(vals)
            span = F.when(lo == hi, manwon(lo)).otherwise(F.concat_ws("~", manwon(lo), manwon(hi)))
            return F.when(k == "", span).otherwise(F.concat_ws(" ", k, span))

        return let(F.transform(F.filter(values, lambda x: x["k"] == k), lambda x: x["v"]), show)

    grouped = let(keyed, lambda values: F.array_join(F.transform(F.array_distinct(F.transform(values, lambda x: x["k"])), lambda k: line(k, values)), "\n"))
    a, c = text(amount), text(condition)
    plain = F.when((c != "") & (a != "") & ~a.contains(c), strip(F.concat_ws(" ", F.coalesce(F.nullif(short_condition(c), F.lit("")), c), a))).otherwise(a)
    first = F.coalesce(F.nullif(F.try_element_at(entries, F.lit(1))["amount"], F.lit("")), a)
    return F.when(F.size(entries) == 0, plain).otherwise(let(grouped, lambda g: F.when(g != "", g).otherwise(first)))


def info(amount, condition, entries: Column) -> Column:
    """R2: (value, conditional, note): the greatest amount, whether it depends on a condition, and the conditions in short."""
    notes = F.array_distinct(F.filter(F.transform(F.filter(entries, lambda e: strip(text(e["condition"])) != ""), lambda e: short_condition(e["condition"])), lambda s: s != ""))
    main = strip(text(condition))
    several = F.size(entries) > 1
    single = ~several & (main != "") & (main.rlike(r"(?U)" + fixed.PERIOD_LIMIT) | ~main.rlike(r"(?U)" + fixed.PERIODIC))
    note = F.when(several, F.array_join(notes, " / ")).when(single, F.coalesce(F.nullif(short_condition(main), F.lit("")), F.regexp_replace(F.substring(main, 1, 20), r"\s+$", ""))).otherwise("")
    return F.struct(F.coalesce(F.array_max(F.transform(entries, lambda e: won(e["amount"]))), won(amount)).alias("value"), (several | single).alias("conditional"), note.alias("note"))


def similarity(a, b, characters: tuple[Column, Column] | None = None) -> Column:
    """Share of common characters of two amounts (their distinct characters may be given); equal texts 1, one missing 0."""
    x, y = characters or (F.array_distinct(F.split(text(a), "")), F.array_distinct(F.split(text(b), "")))
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    return F.when(text(a) == text(b), 1.0).when((text(a) == "") | (text(b) == ""), 0.0).otherwise(share)


def rank(value, items: list[str]) -> Column:
    """Position of a value in a ranked list, by equality without blanks, else by mutual containment; null if absent."""
    v = squeeze(value)
    flat = ["".join(i.split()) for i in items]
    out = F.lit(None).cast("int")
    for i in range(len(flat) - 1, -1, -1):
        out = F.when(v.contains(flat[i]) | F.lit(flat[i]).contains(v), i).otherwise(out)
    for i in range(len(flat) - 1, -1, -1):
        out = F.when(v == flat[i], i).otherwise(out)
    return out


def absent(c) -> Column:
    """Whether a value says that there is none."""
    return strip(text(c)).isin(fixed.NO_VALUE)
