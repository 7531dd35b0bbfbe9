"""Quantities in differing units: segmentation of unit strings and conversion to common units.

A text such as ``1억 5,000만 원``, ``KRW 30,000,000``, ``2년 반`` or ``36M`` is read in two steps. A lattice of the
entries of three tries (prefixes such as 천/만/억, roots such as 원/년/개월/회, exponents) plus number literals is laid
over the text, and a dynamic programme takes the best-scoring path; where an entry has several readings (``M`` month,
million or metre; ``월`` month of a period or the month of a frequency) the score of a reading is the prior of its
dimension in the field the text stands in. The quantities on that path are then summed into one value in the common unit of the dimension wanted
(won for money, months for time).

Defined results: null, empty and text without a quantity of the wanted dimension give null; percentages and counts
are other dimensions and never converted; a bare figure takes the unit of the hint, and without a hint is read in
the base unit if ``bare`` is allowed, else null; a text of any length is read whole; repeated texts are parsed once
per Python worker (bounded memo).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY, TIME, COUNT, PERCENT, LENGTH, DAYS, ORDINAL = "money", "time", "count", "percent", "length", "days", "ordinal"

# Numerals and their worth.
DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
NATIVE = {
    "한": 1, "두": 2, "세": 3, "석": 3, "네": 4, "넉": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10,
    "열한": 11, "열두": 12, "열세": 13, "열네": 14, "열다섯": 15, "열여섯": 16, "열일곱": 17, "열여덟": 18, "열아홉": 19,
    "스무": 20, "스물네": 24, "서른": 30, "서른여섯": 36, "마흔": 40, "쉰": 50, "예순": 60,
}
SMALL = {"십": 10, "백": 100, "천": 1000, "十": 10, "百": 100, "千": 1000}
LARGE = {"만": 10**4, "억": 10**8, "조": 10**12, "萬": 10**4, "億": 10**8}
LATIN_PREFIX = {"k": 10**3, "m": 10**6, "mn": 10**6, "million": 10**6, "thousand": 10**3, "b": 10**9, "bn": 10**9, "billion": 10**9}
# Roots as (spelling, dimension, size in the common unit).
ROOTS = [
    ("원", MONEY, 1), ("원정", MONEY, 1), ("圓", MONEY, 1), ("won", MONEY, 1), ("krw", MONEY, 1), ("₩", MONEY, 1), ("￦", MONEY, 1),
    ("년", TIME, 12), ("년간", TIME, 12), ("년도", ORDINAL, 1), ("年", TIME, 12), ("해", TIME, 12), ("y", TIME, 12), ("yr", TIME, 12),
    ("yrs", TIME, 12), ("yr.", TIME, 12), ("yrs.", TIME, 12), ("year", TIME, 12), ("years", TIME, 12), ("주년", TIME, 12),
    ("개월", TIME, 1), ("개월간", TIME, 1), ("個月", TIME, 1), ("箇月", TIME, 1), ("달", TIME, 1), ("월", TIME, 1), ("月", TIME, 1), ("m", TIME, 1),
    ("mo", TIME, 1), ("mo.", TIME, 1), ("mos", TIME, 1), ("mos.", TIME, 1), ("month", TIME, 1), ("months", TIME, 1), ("반년", TIME, 6),
    ("m", LENGTH, 1), ("미터", LENGTH, 1), ("분기", TIME, 3), ("반기", TIME, 6),
    ("일", DAYS, 1), ("일간", DAYS, 1), ("days", DAYS, 1), ("day", DAYS, 1), ("주", DAYS, 7),
    ("회", COUNT, 1), ("회당", COUNT, 1), ("구좌", COUNT, 1), ("명", COUNT, 1), ("번", COUNT, 1), ("종", ORDINAL, 1), ("급", ORDINAL, 1),
    ("형", ORDINAL, 1), ("세", COUNT, 1), ("배", COUNT, 1), ("호", ORDINAL, 1), ("조", ORDINAL, 1), ("항", ORDINAL, 1), ("차", ORDINAL, 1),
    ("%", PERCENT, 1), ("％", PERCENT, 1), ("퍼센트", PERCENT, 1), ("프로", PERCENT, 1), ("percent", PERCENT, 1),
]
EXPONENTS = {"²": 2, "³": 3, "^2": 2, "^3": 3}
#: Log-prior of a dimension in a field whose common unit has the given dimension.
PRIORS = {
    MONEY: {MONEY: 0.0, TIME: -3.0, COUNT: -2.5, PERCENT: -1.0, DAYS: -3.0, LENGTH: -8.0, ORDINAL: -3.0},
    TIME: {TIME: 0.0, MONEY: -4.0, COUNT: -2.0, PERCENT: -1.0, DAYS: -2.0, LENGTH: -8.0, ORDINAL: -2.0},
}
#: Words that turn the unit after them into a rate (매월 50만원: fifty per month, not a period of a month).
RATE_BEFORE = ("매", "每", "per", "각", "당")

_NUMBER = re.compile(r"(\d+(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:[.,][-–—](?!\d))?")
_SPACE = re.compile(r"[\s ]*")


class Trie:
    """Character trie; ``walk`` yields (end, payloads) of all entries that start at a position, blanks between characters allowed."""

    __slots__ = ("root",)

    def __init__(self, entries: Iterable[tuple[str, object]]):
        self.root: dict = {}
        for word, payload in entries:
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node.setdefault("", []).append(payload)

    def walk(self, text: str, at: int, gaps: bool = False):
        node, i, n = self.root, at, len(text)
        while i < n:
            ch = text[i]
            if gaps and ch == " " and i > at:
                i += 1
                continue
            node = node.get(ch)
            if node is None:
                return
            i += 1
            if "" in node:
                yield i, node[""]


_ROOTS = Trie((w, (d, f)) for w, d, f in ROOTS)
_PREFIXES = Trie([*((w, ("small", v)) for w, v in SMALL.items()), *((w, ("large", v)) for w, v in LARGE.items()), *((w, ("latin", v)) for w, v in LATIN_PREFIX.items())])
_NUMERALS = Trie([*((w, ("digit", v)) for w, v in DIGITS.items()), *((w, ("native", v)) for w, v in NATIVE.items())])
_EXPONENTS = Trie(EXPONENTS.items())


@dataclass(frozen=True)
class Quantity:
    """A number with its dimension (``""`` for a bare figure), in the common unit of the dimension."""

    value: float
    dimension: str
    start: int
    end: int
    arabic: bool


def _skip(text: str, i: int) -> int:
    return _SPACE.match(text, i).end()


def _magnitudes(text: str, at: int):
    """All readings of a number at a position: (end, value, arabic digits seen, pieces)."""
    # state: (position, total, section, current, arabic, pieces, last kind, prefix seen, latin seen)
    out, stack = [], [(at, 0, 0, None, False, 0, "")]
    while stack:
        i, total, section, cur, arabic, n, last = stack.pop()
        if n:
            out.append((i, total + section + (cur or 0), arabic, n, last))
        j = _skip(text, i) if n else i
        if last != "num":
            m = _NUMBER.match(text, j)
            if m and last not in ("digit", "native", "small", "latin"):
                v = m.group(1).replace(",", "")
                stack.append((m.end(), total, section, float(v) if "." in v else int(v), True, n + 1, "num"))
            if last not in ("digit", "native") and not (n and j != i and not arabic and last != "large"):
                for e, ps in _NUMERALS.walk(text, j):
                    for kind, v in ps:
                        if kind == "native" and n:
                            continue
                        stack.append((e, total, section, v, arabic, n + 1, kind))
        if last == "native":
            continue
        for e, ps in _PREFIXES.walk(text, j, gaps=True):
            for kind, v in ps:
                if kind == "small" and last in ("", "num", "digit", "small", "large"):
                    stack.append((e, total, section + (1 if cur is None else cur) * v, None, arabic, n + 1, "small"))
                elif kind == "large" and last in ("", "num", "digit", "small"):
                    stack.append((e, total + ((section + (cur or 0)) or 1) * v, 0, None, arabic, n + 1, "large"))
                elif kind == "latin" and last == "num" and not text[e : e + 1].isalpha():
                    stack.append((e, 0, 0, (cur or 0) * v, arabic, n + 1, "latin"))
    return out


def _readings(text: str, at: int, prior: dict[str, float]):
    """Scored quantities that start at a position: (score, Quantity)."""
    rate = text[:at].rstrip().endswith(RATE_BEFORE)
    for i, value, arabic, pieces, last in _magnitudes(text, at):
        j = _skip(text, i)
        latin = text[j : j + 1].isascii() and text[j : j + 1].isalpha()
        for e, payloads in _ROOTS.walk(text, j, gaps=not latin):
            if latin and text[e : e + 1].isascii() and text[e : e + 1].isalpha():
                continue
            for dim, factor in payloads:
                power, stop = 1, e
                for x, exps in _EXPONENTS.walk(text, e):
                    power, stop = exps[0], x
                if dim == TIME and not arabic and last not in ("digit", "native", "small"):
                    continue
                if not arabic and dim not in (MONEY, TIME):
                    continue
                if last == "native" and dim != TIME or last == "latin" and dim != MONEY:
                    continue
                yield 2.0 * (stop - at) + prior.get(dim, -5.0) - 0.1 * pieces, Quantity(value * factor**power, dim, at, stop, arabic)
        if arabic and last in ("num", "small", "large", "latin"):
            # without a root: a scaled figure is money by itself (30만), a plain figure is bare
            scaled = last != "num"
            if last == "latin" and prior is PRIORS[TIME]:
                continue
            yield 1.2 * (i - at) - 0.1 * pieces, Quantity(value, MONEY if scaled else "", at, i, True)
    for mark in ("krw", "₩", "￦", "won"):
        if text.startswith(mark, at):
            j = _skip(text, at + len(mark))
            for i, value, arabic, pieces, last in _magnitudes(text, j):
                if arabic and last in ("num", "small", "large", "latin"):
                    yield 2.0 * (i - at) + prior.get(MONEY, -5.0) - 0.1 * pieces, Quantity(value, MONEY, at, i, True)
    if text.startswith("반년", at) and not rate:
        yield 2.0 * 2 + prior.get(TIME, -5.0), Quantity(6, TIME, at, at + 2, False)


def segment(text: str, dimension: str) -> list[Quantity]:
    """Best path of quantities over the whole text; characters outside any quantity cost nothing and gain nothing."""
    t = unicodedata.normalize("NFKC", text.replace("₩", "₩")).lower()
    n, prior = len(t), PRIORS[dimension]
    best: list[tuple[float, int, Quantity | None]] = [(0.0, 0, None)] * (n + 1)
    starts = set("₩￦kw반") | set("0123456789") | {w[0] for d in (DIGITS, NATIVE, SMALL, LARGE) for w in d}
    for i in range(n + 1):
        if i and best[i - 1][0] > best[i][0] or i and best[i] == (0.0, 0, None):
            best[i] = (best[i - 1][0], i - 1, None)
        if i == n or t[i] not in starts:
            continue
        if i and t[i].isdigit() and (t[i - 1].isdigit() or t[i - 1] in ",." and i > 1 and t[i - 2].isdigit()):
            continue
        for score, q in _readings(t, i, prior):
            if q.arabic or _word_start(t, i):
                s = best[i][0] + score
                if score > 0 and s > best[q.end][0]:
                    best[q.end] = (s, i, q)
    out, i = [], n
    while i > 0:
        _, back, q = best[i]
        if q is not None:
            out.append(q)
        i = back
    return out[::-1]


def _word_start(t: str, i: int) -> bool:
    """Spelled-out numerals only count at the start of a word (일 in 계약일 is no one) or right after a mark or a digit."""
    return i == 0 or not ("가" <= t[i - 1] <= "힣") or t[:i].endswith(("금액", "기준", "약정", "부터", "최대"))


_UNIT_MARK = re.compile(r"[(\[（]\s*(?:단위\s*[:：]?\s*)?((?:십|백|천|만|억|\s)*원|krw|won)\s*[)\]）]", re.I)


def _unit_size(unit: str) -> int | None:
    """Size of a unit string without number (만원 → 10000), by the same lattice."""
    qs = [q for q in segment("1" + re.sub(r"\s+", "", unit), MONEY) if q.dimension == MONEY]
    return int(qs[0].value) if qs else None


def to_won(text: str | None, hint: str | None = None, bare: bool = True) -> int | None:
    """The sum of money a text states for one payment, in won."""
    if not text or not text.strip():
        return None
    mark = _UNIT_MARK.search(text)
    if mark and not re.search(r"\d\s*(?:십|백|천|만|억|원|krw|won)", text, re.I):
        hint, text = mark.group(1), text[: mark.start()] + " " + text[mark.end() :]
    qs = segment(text, MONEY)
    money = [q for q in qs if q.dimension == MONEY]
    if money:
        return round(money[0].value)
    figures = [q for q in qs if q.dimension == ""]
    if len(figures) != 1 or any(q.dimension == PERCENT for q in qs):
        return None
    if mark is None and re.search(r"[^\W\d_]", re.sub(r"[\d,.\s]", "", text)) and not re.fullmatch(r"(?:기준|가입금액|특약보험가입금액|보험가입금액|금)?[\s:：]*[\d,.\s]+(?:기준|정)?\s*", text):
        return None
    size = _unit_size(hint) if hint else (1 if bare else None)
    return None if size is None else round(figures[0].value * size)


_HALF = re.compile(r"\s*반(?!\w)")


def to_months(text: str | None) -> int | None:
    """The period of years or months a text states, in months; neighbouring parts (2년 6개월, 2년 반) are added."""
    if not text or not text.strip():
        return None
    t = unicodedata.normalize("NFKC", text).lower()
    qs = segment(text, TIME)
    total, end = None, None
    for q in qs:
        if q.dimension != TIME:
            continue
        if total is None:
            total, end = q.value, q.end
        elif re.fullmatch(r"[\s,]*(?:하고|과|와)?\s*", t[end : q.start]):
            total, end = total + q.value, q.end
        else:
            break
    if total is None:
        return None
    m = re.compile(r"\s*반").match(t, end)
    if m and not t[m.end() : m.end() + 1].startswith(("년", "복", "드", "영")):
        total += 6
    return round(total)


_MEMO: dict = {}
_MEMO_LIMIT = 200_000


def _memo(f, key):
    hit = _MEMO.get((f, key), _MEMO)
    if hit is _MEMO:
        if len(_MEMO) >= _MEMO_LIMIT:
            _MEMO.clear()
        hit = _MEMO[(f, key)] = f(*key)
    return hit


def _longs(values: list) -> pd.Series:
    return pd.Series(values, dtype="Int64")


def _won(text: pd.Series, hint: pd.Series) -> pd.Series:
    return _longs([_memo(to_won, (a, h or None)) if a else None for a, h in zip(text, hint)])


def _months(text: pd.Series) -> pd.Series:
    return _longs([_memo(to_months, (a,)) if a else None for a in text])


#: ``to_won`` and ``to_months`` over batches; not deterministic by name only, so that no filter makes Spark run them twice.
won = F.pandas_udf(_won, T.LongType()).asNondeterministic()
months = F.pandas_udf(_months, T.LongType()).asNondeterministic()


def unit_hint(notes: Column, amount: Column) -> Column:
    """Unit of bare figures stated in the row's notes (``(단위 : 천원)``, ``만원 단위로 표시``, ``원 기준임``); read only for bare figures."""
    flat = F.regexp_replace(notes, r"[-‐]?[ \t]*\n[ \t]*", "")
    found = F.regexp_extract(flat, r"(?:단위\s*[:：]?\s*|(?:금액|보험금)(?:은|는|을)\s*)((?:십|백|천|만|억)*\s*원)", 1)
    return F.when(amount.rlike(r"^[^가-힣A-Za-z₩%]*[0-9][^가-힣A-Za-z₩%]*$|^(?:기준|가입금액|특약보험가입금액)[\s:]*[0-9,.]+$|^[0-9,.]+\s*기준$"), found).otherwise(F.lit(""))


def common_amounts(rows: DataFrame) -> DataFrame:
    """(field, key_id, common_value) of ``amount`` and ``reference_amount`` in won; one narrow pass, no shuffle."""
    narrow = rows.select("row_id", "amount", "reference_amount", unit_hint(F.col("notes_summary"), F.col("amount")).alias("ha"), unit_hint(F.col("notes_summary"), F.col("reference_amount")).alias("hr"))
    both = narrow.select("row_id", won("amount", "ha").alias("a"), won("reference_amount", "hr").alias("r"))
    pairs = F.array(F.struct(F.lit("amount").alias("field"), F.col("a").alias("v")), F.struct(F.lit("reference_amount").alias("field"), F.col("r").alias("v")))
    return both.select(F.col("row_id").alias("key_id"), F.explode(pairs).alias("p")).where("p.v is not null").select("p.field", "key_id", F.col("p.v").alias("common_value"))


def common_periods(entries: DataFrame) -> DataFrame:
    """(field, key_id, common_value) of ``condition`` in months."""
    got = entries.select(F.col("entry_id").alias("key_id"), months("condition").alias("common_value"))
    return got.where("common_value is not null").select(F.lit("condition").alias("field"), "key_id", "common_value")
