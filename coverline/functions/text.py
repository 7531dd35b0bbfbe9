"""Text clean-up and extraction as column expressions. Null input counts as "" everywhere and "" means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverline.functions import fixed

_U = "(?U)"  # \s, \d, \w as Unicode classes, as the reference results need


def text(c) -> Column:
    """The column with null as ""."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind (``trim`` only knows the blank)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c) -> Column:
    """Runs of blanks, tabs and line ends to one blank."""
    return strip(F.regexp_replace(text(c), "[ \\t\\n]+", " "))


def squeeze(c) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(c), r"(?U)\s+", "")


def joined_name(c) -> Column:
    """Line ends inside words go, other runs of blanks become one blank."""
    return clean(F.regexp_replace(text(c), r"(?<=[가-힣A-Za-z0-9)])\n(?=[가-힣A-Za-z0-9(])", ""))


def unspaced(c) -> Column:
    """Letter-spaced Hangul closed up."""
    return F.regexp_replace(text(c), r"(?U)(?<=[가-힣])\s+(?=[가-힣])", "")


def split_names(c) -> Column:
    """T5: names joined by a middle dot as an array; parts under two characters or of digits only are dropped."""
    whole = joined_name(c)
    parts = F.transform(F.split(whole, r"(?U)\s*[∙·]\s*"), strip)
    kept = F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.rlike(r"(?U)^[\s\d]+$"))
    return F.when(F.size(kept) > 0, kept).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def reference_amount(c) -> Column:
    """The insured amount a page states as its basis."""
    return F.regexp_extract(text(c), _U + fixed.REFERENCE_AMOUNT, 1)


def repaired_phrases(c: Column) -> Column:
    """Known phrases broken by a blank put together, in order."""
    for broken, whole in fixed.BROKEN_PHRASES:
        c = F.replace(c, F.lit(broken), F.lit(whole))
    return c


def note_text(c) -> Column:
    """Text of a note with line ends inside words removed; line ends before a numbered note stay word boundaries."""
    t = F.regexp_replace(text(c), r"(?U)\n(?=\d{1,2}\.\s)", " \u0000 ")
    for before, after in (("가-힣", "가-힣"), ("가-힣", "A-Za-z0-9"), ("A-Za-z0-9", "가-힣"), ("0-9년개월회%", "이가을를은는의에으"), ("\"')\\]", "가-힣"), ("가-힣", "\"'(\\[")):
        t = F.regexp_replace(t, f"(?<=[{before}])\\n(?=[{after}])", "")
    t = F.replace(F.regexp_replace(t, "[ \\t\\n]+", " "), F.lit(" \u0000 "), F.lit(" "))
    return strip(repaired_phrases(t))


def numbered_notes(c) -> Column:
    """A run of numbered notes as an array; text before the first number is dropped, without numbers it is one note."""
    parts = F.transform(F.split(text(c), r"(?U)(?<=^|\s)(?=\d{1,2}\.\s)"), strip)
    kept = F.filter(parts, lambda p: p.rlike(r"(?U)^\d{1,2}\.(?:\s|$)"))
    whole = strip(text(c))
    return F.when(F.size(kept) > 0, kept).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def renewal_type(c) -> Column:
    """First of the two renewal words."""
    return F.regexp_extract(text(c), fixed.RENEWAL, 0)


def waiting_period(trigger, notes) -> Column:
    """The waiting-period clause of trigger and notes, at most 80 characters."""
    return F.substring(F.regexp_extract(F.concat_ws(" ", text(trigger), text(notes)), _U + fixed.WAITING, 0), 1, 80)


def coverage_limit(c) -> Column:
    """The first limit of years or times."""
    return F.regexp_extract(text(c), _U + fixed.LIMIT, 0)


def match_text(c) -> Column:
    """Name without bracketed parts, dots, slashes, commas and blanks."""
    return F.regexp_replace(F.regexp_replace(text(c), r"\([^)]*\)", ""), r"(?U)[·∙/,\s]+", "")


def without_type(c: Column) -> Column:
    """Without one trailing word for the form of payment."""
    return F.regexp_replace(c, f"(?:{'|'.join(fixed.TYPE_SUFFIXES)})$", "")


def company_key(c) -> Column:
    """Company name for look-ups."""
    return F.lower(F.regexp_replace(strip(text(c)), "[ 　]", ""))


def contract_header(page) -> Column:
    """(name, code, full_name, reference_amount) of the contract header on a page, null without one."""
    pattern = _U + r"■\s*(.+?)\(([A-Za-z0-9]+\.\d+(?:\.\d+)?)\)\s*무배당"
    t = text(page)
    full = clean(F.regexp_replace(F.regexp_extract(t, pattern, 0), "^■+", ""))
    header = F.struct(clean(F.regexp_extract(t, pattern, 1)).alias("name"), F.regexp_extract(t, pattern, 2).alias("code"), full.alias("full_name"), reference_amount(t).alias("reference_amount"))
    return F.when(t.rlike(pattern), header)


def product_name(full_text, title=None, stem=None) -> Column:
    """Product name before the document's title words, else the title, else the file stem."""
    found = clean(F.regexp_extract(text(full_text), r"(?U)(무배당\s+.+?)\s*상품\s*요약\s*서", 1))
    return F.coalesce(F.nullif(found, F.lit("")), *[F.nullif(text(x), F.lit("")) for x in (title, stem) if x is not None], F.lit(""))


def management_no(c) -> Column:
    """The control number printed on a document."""
    return strip(F.regexp_extract(text(c), r"(?U)관리번호\s*([\w\-]+)", 1))


def riders_between_marks(full_text) -> Column:
    """Rider names of the composition section, as an array in order."""
    section = F.regexp_extract(text(full_text), r"(?Us)①\s*상품의\s*구성(.+?)(?=②|◆|$)", 1)
    names = F.transform(F.split(section, "\n"), lambda x: F.regexp_extract(strip(x), r"(?U)^\+\s*\(무\)(.+?)\s*\((?:선택특약|의무부가특약)\)", 1))
    return F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit("무배당"), strip(x)))


def riders_of_cell(c) -> Column:
    """Rider names of a cell of "+" items, distinct in order, longer than three characters."""
    parts = F.split(text(c), r"(?U)\n\+\s*|\s{0,2}\+\s+(?=[가-힣A-Za-z])")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: clean(F.regexp_replace(p, r"(?U)^\+\s*", ""))), lambda n: F.length(n) > 3))
