"""Column functions against stated examples."""

import pytest
from pyspark.sql import functions as F

from coverline.functions import amounts as A
from coverline.functions import classify as C
from coverline.functions import text as X
from coverline.functions.lexicon import DEFAULT, Lexicon, canonical_key, is_raw, key_action


def value(spark, expr, text):
    return spark.createDataFrame([(text,)], "x string").select(expr.alias("y")).first().y


@pytest.mark.parametrize("name,key", [
    ("비급여(전액본인부담 포함) 항암약물 ·방사선치료자금", "비급여|항암방사선"), ("갑상선암 진단자금", "갑상선암|진단"), ("갑상선암 진단특약금", "갑상선암|진단"),
    ("암직접치료 상급종합병원 통원급여금", "상급종합병원|일반암|통원"), ("암직접치료 상급병원 통원비", "일반암|치료"), ("일반암진단자금", "일반암|진단"), ("고액암 진단자금", "고액암|진단"),
    ("표적항암약물허가치료자금", "표적항암약물"), ("암MRI촬영검사비용", "MRI촬영검사"), ("알수없는급부", "알수없는급부"), ("", ""), (None, ""),
    ("유방암/전립선암 치료보험금", "전립선암|치료"), ("재진단암 진단자금", "재진단"), ("암수술급여금", "일반암|수술"), ("소액질병진단자금", "소액질병|진단"),
])
def test_canonical_key(spark, name, key):
    assert value(spark, canonical_key("x"), name) == key


def test_key_parts(spark):
    df = spark.createDataFrame([("갑상선암 진단자금",), ("알수없는급부",)], "x string").withColumn("k", canonical_key("x"))
    assert [tuple(r) for r in df.select(key_action(F.col("k")), is_raw("x", F.col("k"))).collect()] == [("진단", False), ("", True)]


def test_lexicon_merge_keeps_first_label(spark):
    lex = Lexicon.of({"disease": {"A": ["가 나", "다"]}}).merged({"disease": {"B": ["가나", "라"]}, "_note": {"x": ["y"]}})
    assert lex.entries("disease") == [("가나", "A"), ("다", "A"), ("라", "B")]
    with pytest.raises(ValueError):
        Lexicon.of({"x": {"l": [str(i) for i in range(6000)]}})
    assert DEFAULT.labels("action")[0] == "진단"


@pytest.mark.parametrize("text,won", [("1,000만원", 10_000_000), ("1회당 5만원", 50_000), ("0만원", 0), ("1억원", 1), ("보험가입금액의 100%", 100), ("없음", None), ("", None), (None, None)])
def test_won(spark, text, won):
    assert value(spark, A.won("x"), text) == won


@pytest.mark.parametrize("text,limit", [("최대 5년", ("년", 5)), ("최초 1회", ("최초_회", 1)), ("연간1회", ("연간_회", 1)), ("매년 2회", ("연간_회", 2)), ("최대 10회", ("회", 10)), ("한도 없음", None)])
def test_limit(spark, text, limit):
    got = value(spark, A.limit("x"), text)
    assert (got and tuple(got)) == limit


@pytest.mark.parametrize("text,short", [("계약일 부터 2년 이내", "2년이내"), ("2년 후", "2년이후"), ("매년", "매년"), ("가나다라마바사아자차카타파하거너더러머", "가나다라마바사아자차카타파하거…"), (None, "")])
def test_short_condition(spark, text, short):
    assert value(spark, A.short_condition("x"), text) == short


CELLS = [
    ("특약보험가입금액의 100%\n(단, 보험계약일부터 1년이 되는 날까지 50%를 지급)", [("(단, 보험계약일부터 1년이 되는 날까지 50%를 지급)", "특약보험가입금액의 100%", "보험계약일부터 1년이 되는 날까지 50%를 지급")]),
    ("3,000만원", [("", "3,000만원", "")]), ("500만원\n(단, 보험계약일부터 2년이 지나면 50%를 지급)", [("", "500만원", "보험계약일부터 2년이 지나면 50%를 지급")]),
    ("매월 100만원\n(다만, 3년)", [("매월", "100만원", "")]),
    ("최초계약의 계약일부터 1년 이내 500만원 최초계약의 계약일부터 1년 후 1,000만원", [("최초계약의 계약일부터 1년 이내", "500만원", ""), ("최초계약의 계약일부터 1년 후", "1,000만원", "")]),
    ("별도로 정함", [("별도로 정함", "", "")]), ("", []), (None, []),
]


@pytest.mark.parametrize("cell,entries", CELLS)
def test_cell_amounts(spark, cell, entries):
    assert [tuple(e) for e in value(spark, A.cell_amounts("x"), cell)] == entries


def test_folded_amounts(spark):
    got = spark.createDataFrame([(["1년 이내", "100만원", "(단, 감액)", "", "1년 후 200만원"],)], "x array<string>").select(A.folded_amounts(F.col("x")).alias("y")).first().y
    assert [tuple(e) for e in got] == [("1년 이내", "100만원", "(단, 감액)"), ("1년 후", "200만원", "")]


def test_display_and_info(spark):
    entries = '[{"amount":"1,500만원","condition":"1년 이내"},{"amount":"3,000만원","condition":"1년 이후"}]'
    df = spark.createDataFrame([("3,000만원", "", entries), ("500만원", "매년", ""), ("500만원", "2년 이내", "{}"), (None, None, None)], "a string, c string, d string")
    got = df.select(A.display("a", "c", A.detail(F.col("d"))).alias("s"), A.info("a", "c", A.detail(F.col("d"))).alias("i")).collect()
    assert got[0].s == "1년이내 1,500만원\n1년이후 3,000만원" and tuple(got[0].i) == (30_000_000, True, "1년이내 / 1년이후")
    assert got[1].s == "매년 500만원" and tuple(got[1].i) == (5_000_000, False, "")
    assert tuple(got[2].i) == (5_000_000, True, "2년이내") and tuple(got[3].i) == (None, False, "") and got[3].s == ""


@pytest.mark.parametrize("text,repaired", [
    ("보험계\n약", "보험계약"), ("지\n급\n사\n유", "지급사유"), ("보험\n2년이내", "보험2년이내"), ("2년\n이 지난", "2년이 지난"), ("50%\n를 지급", "50%를 지급"),
    ("\"갑상선암\"\n으로 봄", "\"갑상선암\"으로 봄"), ("보험  계약   일", "보험 계약 일"), ("상기 금 액의 50%", "상기 금액의 50%"), ("가\n1. 나", "가 1. 나"), (None, ""),
])
def test_note_text(spark, text, repaired):
    assert value(spark, X.note_text("x"), text) == repaired


def test_names_and_notes(spark):
    assert value(spark, X.joined_name("x"), "유방암/전립\n선암 치료보\n험금") == "유방암/전립선암 치료보험금"
    assert value(spark, X.split_names("x"), "일반암 진단자금∙고액암 진단자금") == ["일반암 진단자금", "고액암 진단자금"]
    assert value(spark, X.split_names("x"), None) == [] and value(spark, X.split_names("x"), "7") == ["7"]
    assert value(spark, X.numbered_notes("x"), "앞쪽 잔여 3. 세 번째 내용입니다.") == ["3. 세 번째 내용입니다."]
    assert value(spark, X.numbered_notes("x"), "1. 약관 제3호 제14조 2. 둘") == ["1. 약관 제3호 제14조", "2. 둘"]
    assert value(spark, X.numbered_notes("x"), "번호 없음") == ["번호 없음"] and value(spark, X.numbered_notes("x"), None) == []


def test_terms(spark):
    assert value(spark, X.renewal_type("x"), "특약(비갱신형)") == "비갱신형" and value(spark, X.renewal_type("x"), "특약(갱신형)") == "갱신형"
    assert value(spark, X.reference_amount("x"), "(기준 : 특약가입금액 1,000만원)") == "1,000만원"
    assert value(spark, X.coverage_limit("x"), "진단 (최초 1회에 한함)") == "최초 1회"
    assert value(spark, X.unspaced("x"), "급 부 명 칭") == "급부명칭"


@pytest.mark.parametrize("name,text,kind", [("상품요약서_S.pdf", "", "summary"), ("보통약관.pdf", "", "terms"), ("C12_3_S.pdf", None, "summary"), ("plain.pdf", "", "unknown"), ("a.pdf", "급부명 지급 사유", "summary"), ("a.pdf", "제1조 제2조 급부명", "terms")])
def test_document_type(spark, name, text, kind):
    got = spark.createDataFrame([(name, text)], "n string, t string").select(C.document_type("n", "t")).first()[0]
    assert got == kind


def test_categories(spark):
    rows = [("암진단보험금", "암으로 진단확정", "암보험", "diagnosis"), ("암직접치료급여금", "치료", "암보험", "treatment"), ("알수없음", "", "암보험", "other"), ("요양병원입원", "", "암보험", "hospitalization"), (None, None, "default", "other")]
    df = spark.createDataFrame([r[:3] for r in rows], "n string, t string, k string")
    assert [r[0].category for r in df.select(C.benefit_category("n", "t", F.col("k"))).collect()] == [r[3] for r in rows]
    assert value(spark, C.insurance_type("x", F.lit("")), "든든 치매보험") == "치매보험" and value(spark, C.cancer_class("x"), "갑상선암 진단") == "소액암"


def test_similarity_and_rank(spark):
    df = spark.createDataFrame([("100만원", "200만원"), ("", "1"), ("", ""), (None, None)], "a string, b string")
    assert [round(r[0], 2) for r in df.select(A.similarity("a", "b")).collect()] == [0.75, 0.0, 1.0, 1.0]
    assert value(spark, A.rank("x", ["가 나", "다"]), "가나") == 0 and value(spark, A.rank("x", ["가", "다"]), "큰다") == 1
