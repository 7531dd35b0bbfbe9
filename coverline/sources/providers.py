"""Edges a deployment fills in: layout of documents, and slots from a language model. Offline defaults give nothing and say so."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverline.functions.text import text

LAYOUT = "doc_id string, page_idx int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, error string"
SLOTS = "struct<payment_freq:string,payment_limit:string,reduction_rule:string,start_condition:string,trigger:string,amount_display:string,amount_value:long>"
#: Rows of one request.
BATCH = 8

Extractor = Callable[[bytes], list[tuple]]
_EXTRACTORS: dict[str, Extractor] = {}
_LAYOUTS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_layout(company: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """The transform that makes contracts of a company's layout; companies are told apart without blanks and case."""
    _LAYOUTS["".join(company.split()).lower()] = transform


def by_company(layout: DataFrame, company_key: str, generic: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every company's layout by its own transform, the rest by the generic one."""
    out = generic(layout.where(~F.col(company_key).isin(*_LAYOUTS))) if _LAYOUTS else generic(layout)
    for company, transform in _LAYOUTS.items():
        out = out.unionByName(transform(layout.where(F.col(company_key) == company)), allowMissingColumns=True)
    return out


def no_layout(content: bytes) -> list[tuple]:
    """Default extractor: none is installed."""
    raise RuntimeError("no document extractor is registered")


def blocks_of(found: DataFrame, extract: Extractor = no_layout) -> DataFrame:
    """Text blocks of files; a file that fails gives one row with its error, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, *b, None) for b in extract(content)]
                except Exception as e:  # noqa: BLE001 - a bad file must not stop the others
                    rows.append((path, None, None, None, None, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LAYOUT.split(", ")])

    return found.select("path", "content").mapInPandas(run, LAYOUT)


Ask = Callable[[str], str | None]


def no_answer(prompt: str) -> str | None:
    """Default model: none is configured, so nothing is filled in."""
    return None


def first_answer(models: list[Ask]) -> Ask:
    """A chain of models; the first that answers counts."""

    def ask(prompt: str) -> str | None:
        for m in models:
            try:
                if (got := m(prompt)) is not None:
                    return got
            except Exception:  # noqa: BLE001 - the next model is tried
                continue
        return None

    return ask


def prompt_of(rows: list[dict]) -> str:
    """L2: a numbered request for one JSON list with one object per row."""
    return "Return one JSON array with one object per item, in order.\n" + "\n".join(f"{i + 1}. {json.dumps(r, ensure_ascii=False)}" for i, r in enumerate(rows))


def answer_slots(answer) -> Column:
    """L2: the list of slot records in a free-text answer, null if there is none."""
    found = F.regexp_extract(text(answer), r"(?s)\[.*\]", 0)
    return F.when(found != "", F.from_json(found, f"array<{SLOTS}>"))


def enrich(rows: DataFrame, ask: Ask = no_answer, fields: tuple[str, ...] = ("insurer", "benefit_name", "trigger", "amount", "amount_condition"), batch: int = BATCH) -> DataFrame:
    """Rows with their slots as JSON text filled in where they are null, by requests of a few rows; a failed request leaves null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            todo = pdf.index[pdf["slots"].isna()]
            for k in range(0, len(todo), batch):
                part = todo[k : k + batch]
                try:
                    reply = ask(prompt_of(pdf.loc[part, list(fields)].fillna("").to_dict("records")))
                    items = json.loads(reply[reply.index("[") : reply.rindex("]") + 1]) if reply else []
                except Exception:  # noqa: BLE001 - a failed request leaves its rows unfilled
                    items = []
                for i, item in zip(part, items):
                    if isinstance(item, dict):
                        pdf.at[i, "slots"] = json.dumps(item, ensure_ascii=False)
            yield pdf

    return rows.mapInPandas(run, T.StructType([f if f.name != "slots" else T.StructField("slots", T.StringType()) for f in rows.schema]))


def needing_slots(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Only rows of matched pairs whose slots are null."""
    matched = pairs.where("match_type = 'matched'").select(F.col(f"{side}_ord").alias("ord")).distinct()
    return rows.where("slots is null").join(matched, "ord", "left_semi")


def with_cached_slots(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Slots from a cache of (insurer, benefit_name, slots); only nulls are filled."""
    c = cache.groupBy("insurer", "benefit_name").agg(F.max("slots").alias("cached"))
    return rows.join(c, ["insurer", "benefit_name"], "left").withColumn("slots", F.coalesce("slots", "cached")).drop("cached")


def resolved(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """L3: pairs that differ in conditions, with the verdict of a second look where it names a winner."""
    v = verdicts.where(F.col("verdict").isin("당사우위", "타사우위")).select("our_ord", "comp_ord", "verdict")
    joined = pairs.join(v, ["our_ord", "comp_ord"], "left")
    return joined.withColumn("advantage", F.when(F.col("advantage") == "조건상이", F.coalesce("verdict", "advantage")).otherwise(F.col("advantage"))).drop("verdict")
