"""Routing and classification by ordered keywords: the first keyword in the order of the lists decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.functions import fixed
from coverline.functions.text import text


def first_of(t: Column, lists: list[tuple], otherwise) -> Column:
    """Label of the first (label, keywords) entry with a keyword in the text."""
    out = None
    for label, words in lists:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def document_type(filename, first_pages) -> Column:
    """Summary, terms or unknown: by name, else by counts of typical phrases on the first pages."""
    s, t = (F.regexp_count(text(first_pages), F.lit(p)) for p in (fixed.SUMMARY_TEXT, fixed.TERMS_TEXT))
    return (
        F.when(text(filename).rlike(fixed.SUMMARY_NAME), "summary").when(text(filename).rlike(fixed.TERMS_NAME), "terms")
        .when((s > t) & (s >= 2), "summary").when((t > s) & (t >= 2), "terms").when(s > 0, "summary").when(t > 0, "terms").otherwise("unknown")
    )


def resolved_type(doc_type: Column, n_contracts: Column) -> Column:
    """An unknown document is a summary if contracts were found in it, else terms."""
    return F.when(doc_type == "unknown", F.when(n_contracts > 0, "summary").otherwise("terms")).otherwise(doc_type)


def insurance_type(product, source) -> Column:
    """C4: kind of insurance by product name and source."""
    return first_of(F.lower(F.concat_ws(" ", text(product), text(source))), fixed.INSURANCE_TYPES, "default")


def benefit_category(name, trigger, kind, categories: dict = fixed.CATEGORIES) -> Column:
    """(category, label): by name in the kind's lists then the default's, else by name and trigger, else other."""

    def found(t: Column) -> Column:
        def lookup(section: str):
            out = None
            for cat, label, words in categories.get(section, []):
                hit = F.lit(False)
                for w in words:
                    hit = hit | t.contains(w)
                value = F.struct(F.lit(cat).alias("category"), F.lit(label).alias("label"))
                out = F.when(hit, value) if out is None else out.when(hit, value)
            return F.lit(None) if out is None else out

        by_kind = None
        for section in categories:
            if section != "default":
                by_kind = F.when(kind == section, lookup(section)) if by_kind is None else by_kind.when(kind == section, lookup(section))
        return F.coalesce(by_kind, lookup("default"))

    other = F.struct(F.lit(fixed.OTHER[0]).alias("category"), F.lit(fixed.OTHER[1]).alias("label"))
    both = F.when(text(trigger) != "", found(F.concat_ws(" ", text(name), text(trigger))))
    return F.coalesce(found(text(name)), both, other)


def cancer_class(name) -> Column:
    """Class of cancer by ordered keywords, "" for none."""
    return first_of(text(name), fixed.CANCER_CLASSES, "")


def filled_categories(rows: DataFrame, kind: str) -> DataFrame:
    """Rows whose blank category is worked out; what is there stays."""
    c = benefit_category("benefit_name", "trigger", F.col(kind))
    blank = text("benefit_category") == ""
    return rows.withColumn("_c", F.when(blank, c)).withColumns({"benefit_category": F.when(blank, F.col("_c.category")).otherwise(F.col("benefit_category")), "benefit_category_ko": F.when(blank, F.col("_c.label")).otherwise(F.col("benefit_category_ko"))}).drop("_c")


def classified_uploads(files: DataFrame) -> DataFrame:
    """(path, filename, doc_type, label, is_hint_only) of files with the text of their first pages."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    typed = files.select("path", name.alias("filename"), document_type(name, "first_pages").alias("doc_type"))
    label = F.when(F.col("doc_type") == "summary", "상품요약서").when(F.col("doc_type") == "terms", "약관").otherwise("알 수 없음")
    return typed.select("path", "filename", "doc_type", label.alias("label"), F.lit(True).alias("is_hint_only"))
