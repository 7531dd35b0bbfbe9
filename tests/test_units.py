"""Quantities in differing units."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coverline.operators.units import common_amounts, common_periods, segment, to_months, to_won

WON = [
    ("1,000만원", 10_000_000), ("오천만 원", 50_000_000), ("일억사천만원정", 140_000_000), ("3.0억원", 300_000_000), ("300백만원", 300_000_000), ("1억 5,000만 원", 150_000_000),
    ("(천원) 3,000", 3_000_000), ("70,000 [단위: 천원]", 70_000_000), ("2,000,000 (원)", 2_000_000), ("KRW 4,000,000", 4_000_000), ("500,000 won", 500_000), ("₩100,000,000", 100_000_000),
    ("30만", 300_000), ("50천원", 50_000), ("최초 1회에 한하여 20,000,000원", 20_000_000), ("1구좌 기준 100만원", 1_000_000), ("3년간 매년 500만원", 5_000_000), ("매월 50만원씩", 500_000),
    ("70,000,000.-원", 70_000_000), ("금 7,000,000원정", 7_000_000), ("보험가입금액의 200%", None), ("별도 산출", None), ("천오백만원정", 15_000_000), ("5,000만원(세전)", 50_000_000), ("-", None), ("", None), (None, None),
]
MONTHS = [
    ("2년 6개월 이내", 30), ("2년 반경과 후", 30), ("반년 안에", 6), ("36M 안에", 36), ("가입 후 10 yrs 안에", 120), ("2종 가입자, 2.5년 안에", 30), ("일년 육개월초과", 18), ("여섯 달", 6), ("네 해 안에", 48),
    ("36個月이내", 36), ("24 mos. 안에", 24), ("6월 이내", 6), ("매월 (최대 36회)", None), ("상급병원 한정", None), ("(50% 감액) 백이십개월경과 후", 120), ("2종 가입자", None), ("50% 감액 적용", None), ("3Y미만", 36), (None, None),
]


@pytest.mark.parametrize("text,won", WON)
def test_won(text, won):
    assert to_won(text) == won


@pytest.mark.parametrize("text,months", MONTHS)
def test_months(text, months):
    assert to_months(text) == months


def test_bare_figures_take_the_hint():
    assert to_won("1,000", "천원") == 1_000_000 and to_won("700", "만원") == 7_000_000 and to_won("700", None, bare=False) is None


DIGITS = "영일이삼사오육칠팔구"


def spelled(n: int) -> str:
    """Independent spelling of a number below 10**8."""

    def four(k):
        return "".join(("" if d == 1 and u else DIGITS[d]) + u for d, u in zip(map(int, f"{k:04d}"), ("천", "백", "십", "")) if d)

    hi, lo = divmod(n, 10_000)
    return (four(hi) + "만" if hi else "") + (four(lo) if lo else "")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 99_999_999))
def test_spelled_numbers_round_trip(n):
    assert to_won(spelled(n) + "원") == n
    assert to_won(f"{n:,}원") == n and to_won(f"{n}천원") == n * 1000


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_read(text):
    to_won(text), to_months(text), segment(text, "money")


def test_tables(spark):
    rows = spark.createDataFrame([(1, "700", "2천만원", "1. (단위 : 만원)", 9), (2, None, "", None, 9), (3, "30%", "별도", "", 9), (4, "3만원 " + "가" * 20_000, None, None, 9)], "row_id long, amount string, reference_amount string, notes_summary string, v int")
    assert {tuple(r) for r in common_amounts(rows).collect()} == {("amount", 1, 7_000_000), ("reference_amount", 1, 20_000_000), ("amount", 4, 30_000)}
    assert common_amounts(rows.limit(0)).count() == 0
    entries = spark.createDataFrame([(1, "2년 반", 0), (2, None, 0), (2, "6월", 0), (3, "", 0)], "entry_id long, condition string, months int")
    assert sorted(tuple(r) for r in common_periods(entries).collect()) == [("condition", 1, 30), ("condition", 2, 6)]
