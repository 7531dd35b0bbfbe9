"""Formatting copies, look-alikes, scans and sentences."""

import json
import random
import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coverline.llm import confusables as L
from coverline.llm import formatting as D
from coverline.llm import scans as S
from coverline.llm.sentences import sentence_units, units

ALL = [*D.FIELDS, *D.JSON_FIELDS]


def canon(row):
    out = []
    for f in ALL:
        v = row[f] or ""
        if f in D.JSON_FIELDS:
            try:
                v = [sorted((k, str(x)) for k, x in o.items()) for o in json.loads(v)]
                v = json.dumps(v, ensure_ascii=False)
            except ValueError:
                pass
        out.append("".join(c for c in v if not c.isspace() and unicodedata.category(c)[0] != "P").lower())
    return tuple(out)


def test_copies_equal_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/summary_rows.parquet")
    groups = defaultdict(list)
    for r in rows.collect():
        groups[canon(r.asDict())].append(r.row_id)
    want = {(min(v), len(v)) for v in groups.values() if len(v) > 1}
    assert {tuple(r) for r in D.copies_found(rows).collect()} == want and want
    assert D.collisions(rows).count() == 0


def test_copies_edges(spark):
    base = {f: None for f in ALL}
    make = lambda i, **kw: {"row_id": i, **base, **kw, "canon": "x", "h128": "y", "check": i}
    rows = [make(1), make(2, trigger=""), make(3, trigger="A-b c"), make(4, trigger="a B　C."), make(5, amount="a", trigger="bc"), make(6, amount="ab", trigger="c"), make(7, amount_detail='[{"a":"1","b":"2"}]'), make(8, amount_detail='[ {"b": "2", "a": "1"} ]'), make(9, amount_detail="[broken"), make(10, trigger="가" * 100_000), make(11, trigger="가 " * 100_000)]
    schema = "row_id long, " + ", ".join(f"{f} string" for f in ALL) + ", canon string, h128 string, check long"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    assert {tuple(r) for r in D.copies_found(df).collect()} == {(1, 2), (3, 2), (7, 2), (10, 2)}
    assert D.copies_found(df.limit(0)).count() == 0
    assert D.collapse(df.union(df)).agg(F.sum("n_copies")).first()[0] == 22


@pytest.mark.parametrize("a,b,same", [
    ("Top-Line Ⅲ", "Τоp‐Lіnе III", True), ("위암 진단비", "위​암 진단비", True), ("가나", unicodedata.normalize("NFD", "가나"), True), ("Noé", "Noé", True), ("A형", "Ａ형", True),
    ("초음파·내시경", "초음파‧내시경", True), ("A형", "a형", False), ("가 나", "가나", False), ("가 나", "가  나", False), ("Μόσχα", "Mocxa", False), ("OK안심", "ОК안심", True), ("(무)가", "（무）가", True),
])
def test_look(a, b, same):
    assert (L.one_form(a) == L.one_form(b)) == same


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_one_form_is_stable(text):
    once = L.one_form(text)
    assert L.one_form(once) == L.one_form(L.one_form(once))


def test_looks_found(spark):
    rows = spark.createDataFrame([(1, "P", "위​암 진단비", "특약 A"), (2, "P", "위암 진단비", "특약 Ａ"), (3, "Q", None, "특약 Ａ"), (4, "P", "", None), (5, "P", "위암  진단비", "특약 a"), (6, None, "위암 진단비", "특약 Α"), (7, "P", "위" * 20_000, "특약 А")], "row_id long, product_name string, benefit_name string, contract_name string")
    cat = spark.createDataFrame([(10, "위암 진단비"), (11, None)], "canonical_id long, canonical_name string")
    con = spark.createDataFrame([(20, "P", "특약 A"), (21, None, None)], "contract_id long, product_name string, contract_name string")
    want = {("benefit_name", 1, 10), ("benefit_name", 6, 10), ("contract_name", 2, 20), ("contract_name", 7, 20)}
    assert {tuple(r) for r in L.looks_found(rows.withColumn("bf", F.lit(1)), cat, con.withColumn("id", F.lit(0))).collect()} == want
    assert L.looks_found(rows.limit(0), cat, con).count() == 0 and L.looks_found(rows, cat.limit(0), con.limit(0)).count() == 0


# --- scans -----------------------------------------------------------------------------------------------------------

PARTS = ["계약일부터 {n}일이 지난 날 이후 피보험자가", "보험기간 중 피보험자가", "갱신계약의 보험기간 중 피보험자가"]
MIDDLE = ["위암(분류코드 C{n}) 상태로 인하여", "최초로 발생한 골절(질병코드 S{n})의 결과로", "약관에서 정한 당뇨병(E{n})의 사유로"]
ENDS = ["수술을 받았을 때", "외래로 통원하여 진료를 받은 경우", "진단 확정되었을 때", "필요한 검사를 받은 경우 (최초 {n}회에 한함)"]


def corpus(n, seed):
    rng = random.Random(seed)
    fill = lambda t: t.replace("{n}", str(rng.randint(10, 99)))
    return [" ".join(fill(rng.choice(p)) for p in (PARTS, MIDDLE, ENDS)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return S.train(corpus(1500, 1))


def test_held_out_damage_is_found_and_repaired(model):
    rng = random.Random(2)
    hit = miss = false = whole = 0
    for text in corpus(300, 3):
        assert S.repair(text, model) == (text, [])
        words = text.split(" ")
        i = rng.randrange(1, len(words) - 1)
        kind = rng.choice(["split", "hyphen", "page", "header", "space", "misread"])
        if kind in ("split", "hyphen"):
            k = max((j for j in range(len(words)) if len(words[j]) > 2 and all("가" <= c <= "힣" for c in words[j])), key=lambda j: rng.random())
            cut = rng.randint(1, len(words[k]) - 1)
            bad, want = " ".join([*words[:k], words[k][:cut] + ("-" if kind == "hyphen" else "") + "\n" + words[k][cut:], *words[k + 1 :]]), ["split_word"]
        elif kind == "misread":
            k = max((j for j in range(len(words)) if len(words[j]) > 2 and all("가" <= c <= "힣" for c in words[j])), key=lambda j: rng.random())
            c = rng.randrange(len(words[k]))
            if not S.alike(words[k][c]):
                continue
            bad, want = " ".join([*words[:k], words[k][:c] + rng.choice(S.alike(words[k][c])) + words[k][c + 1 :], *words[k + 1 :]]), ["misread"]
        else:
            line = {"page": rng.choice(["- 12 -", "p. 7", "제3쪽", "3 / 40", "〔9〕", "Seite 12 von 30", "xii"]), "header": rng.choice(["무지개생명 안내문 2024", "[가나다 건강플랜 0000012] 주요 내용", "ABC Life Product Guide", "대외비"]), "space": None}[kind]
            bad = " ".join(words[:i]) + "\n" + (line + "\n" if line else "") + " ".join(words[i:])
            want = {"page": ["pageno"], "header": ["header"], "space": []}[kind]
        fixed, got = S.repair(bad, model)
        hit += got == want
        miss += not set(want) <= set(got)
        false += not set(got) <= set(want)
        whole += fixed == text
    assert hit / (hit + miss + false) > 0.95 and whole / 300 > 0.85


DAMAGE = {  # dropped, added, outside the look-alike table, read as a digit, two for one, one for two
    "dropped": ("피보험자가", "피보자가"), "added": ("상태로", "상태읗로"), "foreign": ("보험기간", "보줄기간"), "digit": ("인하여", "인7여"), "two for one": ("진료를", "진로뢰를"), "one for two": ("피보험자가", "피봄자가"), "mark": ("피보험자가", "피보.자가"),
}


@pytest.mark.parametrize("kind", DAMAGE)
def test_editor_replaces_deletes_and_inserts(model, kind):
    right, wrong = DAMAGE[kind]
    text = "보험기간 중 피보험자가 위암(분류코드 C16) 상태로 인하여 외래로 통원하여 진료를 받은 경우"
    assert S.repair(text.replace(right, wrong, 1), model) == (text, ["misread"])


def test_formatting_is_no_misreading(model):
    for text in ("보험기간  중 '피보험자가 위암(분류코드 c16) 상태로, 인하여 외래로통원하여 진료를 받은 경우'", "갱신계약의/보험기간 중 피보험자가 최초로   발생한 골절(질병코드 S12)의 결과로 진단 확정되었을 때;"):
        assert S.repair(text, model) == (text, [])


def test_counts_go_over_all_texts(spark):
    rare = "보험기간 중 피보험자가 소뇌위축증(질병코드 G{}) 판정을 받은 경우"
    texts = [*corpus(600, 5), *[rare.format(n) for n in range(10, 30)], "보험기간 중\n피보험자가", "", None]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "row_id long, trigger string, notes_summary string")
    entries = spark.createDataFrame([(1, "소뇌위축증 1회")], "entry_id long, reduction_note string")
    everything = S.count_all(S.running_texts(rows.repartition(3), entries))
    flat = [t for t in [*texts, "소뇌위축증 1회"] if t and "\n" not in t]
    assert everything.known["위축증"] == 21 and everything.words["피보험자가"] == sum(t.count("피보험자가") for t in flat) and everything.fillings["소뇌축증"] == {"위": 21}
    only, both = S.train(corpus(600, 5)), S.train(corpus(600, 5), everything=everything)  # the sample lacks the rare texts
    assert S.repair(rare.format(16).replace("위축", "위죽"), only)[0] != rare.format(16) and S.repair(rare.format(16), both) == (rare.format(16), [])
    assert S.repair(rare.format(16).replace("위축증", "위증"), both) == (rare.format(16), ["misread"])


def test_lost_blanks_are_no_known_words():
    counts = S.count_pieces([("진단의 결과로 본 때", 500), ("진단의결과로 본 때", 9)], set())
    assert "진단의결과로" not in S.Counts(set(), counts).words and "결과로" in S.Counts(set(), counts).words


def test_memo_changes_no_answer(model):
    fresh = lambda: S.Model(model.editor, model.joiner, model.liner, model)
    sides = [(a, b) for a in ("보험기간중피보험자가외래로통원하여진료", "갱신계약의보험기간중피보험자가외래로통원하여진료", "가", ") 가", "수술을") for b in ("를", "를 받", "를, 받", "의결과로진단확정되었을때또는", "의결과로진단확정되었을때그리고")]
    assert len({k for a, b in sides for m in [fresh()] if (m.breaks(a, b, False, False) or 1) for k in m.joins}) == len({tuple(S.join_features(a, b, False, False, model.words)) for a, b in sides})
    memo = fresh()
    befores = ("끝-", ". -", "끝 ", ". ", "끝", "(최초")
    asked = [(b, x) for b in befores for x in (("회에 한함",), ("회에는 지급", "다음"), ())]
    for b, x in asked:
        memo.line_kind("p. 3", "inner", False, b, x)
    read = {tuple(S.line_features("p. 3", "inner", False, S._unfinished(b), S._edges(b, "")[0], tuple(S._edges("", y)[1] for y in x), model.known)) for b, x in asked}
    assert len(read) <= len(memo.lines) < len(asked) and all(memo.line_kind("p. 3", "inner", False, b, x) == fresh().line_kind("p. 3", "inner", False, b, x) for b, x in asked)
    assert all(memo.breaks(a, b, False, False) == fresh().breaks(a, b, False, False) for a, b in sides)


def test_scan_edges(spark, model):
    rows = spark.createDataFrame([(1, "보험기간 중 피보-\n험자가 위암(분류코드 C10) 상태로 인하여 수술을 받았을 때", None), (2, None, ""), (3, "한 줄", "1. 가\n2. 나"), (None, "x", "y"), (4, "가 " * 30_000, "p. 3")], "row_id long, trigger string, notes_summary string")
    entries = spark.createDataFrame([(1, None), (2, "")], "entry_id long, reduction_note string")
    rows, entries = (df.withColumns({c: F.lit(1) for c in ("field", "text", "defect", "defects", "h")}) for df in (rows, entries))
    found = {tuple(r) for r in S.defects_found(rows, entries, model).collect()}
    assert ("trigger", 1, "split_word") in found and not any(k in (2, 3) for _, k, _ in found)
    texts = {(r.field, r.key_id): r.text for r in S.repaired(rows, entries, model).collect()}
    assert texts[("trigger", 1)] == "보험기간 중 피보험자가 위암(분류코드 C10) 상태로 인하여 수술을 받았을 때" and texts[("notes_summary", 3)] == "1. 가 2. 나"
    assert S.defects_found(rows.limit(0), entries.limit(0)).count() == 0


# --- sentences -------------------------------------------------------------------------------------------------------

SENTENCES = [
    "A.M.L. 점검과 K.Y.C. 확인은 같은 날에 끝납니다.", "상담원은 \"보험금은 17일 안에 지급됩니다.\"라고 안내하였습니다.", "계약자는 '해지하겠습니다. 환급금을 보내 주세요.'라는 메모를 남겼습니다.",
    "고객은 “정말 3,000만원이 나오나요?” 하고 다시 물었습니다.", "“고객님, 서류를 확인했습니다. 내일 지급됩니다.” 담당자의 답변은 여기까지였다.", "2024. 1. 22.자로 개정된 약관을 따릅니다.", "글쎄요… 그 부분은 약관을 보아야 합니다.",
    "약관 제28.2조에 따라 감액 기간에는 50%만 지급합니다(단, 재해로 인한 사고는 감액하지 않습니다.).", "보험료는 2020. 3. 1. 현재 기준으로 계산하였습니다.", "문의는 care.18@example.invalid 로 보내 주세요.", "접수 시각은 오후 8:30 이전이어야 함.",
    "Dr. Hale of the claims desk said, \"We need the original receipt. A copy is not enough.\" before closing the file.", "Mr. and Mrs. Example asked whether St. Orla Hospital is listed.", "We regret the delay... the scan was unreadable.", "Claims over the limit (see Sec. 19.) are reviewed by hand.",
    "\"Will it pay out?\" the caller asked again.", "Ms. Sample, Ph.D., reviewed item 6.9 of the annex.", "Send it to Claims Dept., Bldg. 12, by 5 p.m. sharp.", "The U.S. branch keeps a separate register.", "What is covered, and what is not?",
    "डॉ. की रिपोर्ट के बिना दावा स्वीकार नहीं होगा।", "अधिकारी ने कहा, “कागज़ अधूरे हैं। फिर से भेजें।” और फ़ोन रख दिया।",
]
CJK = ["担当者は「書類が足りません。もう一度お送りください。」と説明しました。", "第27.2条により、免責期間中は10%のみ支払います（災害の場合を除きます。）。", "更新後の保険料は上がりますか？", "客服说：“材料不全。请补交原件。”然后挂断了电话。", "投保人留言“我要退保。”并附上了账号。"]
THAI = ["ระยะเวลารอคอยคือ 120 วันนับจากวันเริ่มสัญญา", "เจ้าหน้าที่แจ้งว่า “เอกสารยังไม่ครบ” แล้ววางสาย", "รายละเอียดปรากฏในตารางแนบท้ายหมายเลข 27", "กรมธรรม์นี้ไม่คุ้มครองการศัลยกรรมเสริมความงาม"]
LISTS = ["1. 보험증권을 분실한 때에는 재발급을 신청합니다.\n2. 서류", "① 가\n② 나", "- a. b.\n- c"]


@pytest.mark.parametrize("seed", range(30))
def test_round_trip_of_known_sentences(seed):
    rng = random.Random(seed)
    text, want = "", []
    for _ in range(rng.randint(1, 6)):
        kind = rng.choice(["spaced", "cjk", "thai", "list", "wrapped", "heading", "unspaced"])
        if kind == "list":
            lines = rng.choice(LISTS)
            parts, joint = lines.split("\n"), "\n"
        elif kind == "heading":
            parts, joint = [rng.choice(["유의사항", "제4조 (보험금의 청구)", "22. 보험금 지급사유", "Sec. 19 Claims"])], ""
        else:
            pool = {"cjk": CJK, "thai": THAI}.get(kind, SENTENCES)
            parts, joint = [rng.choice(pool) for _ in range(rng.randint(1, 5))], "" if kind == "cjk" else " "
            if kind == "unspaced":
                parts, joint = [p for p in parts if p[0] not in "“\"2डअ"][:2] or [SENTENCES[0]], ""
        for i, p in enumerate(parts):
            if kind == "wrapped" and " " in p:
                at = rng.choice([j for j, c in enumerate(p) if c == " "])
                p = p[:at] + "\n" + p[at + 1 :]
            want.append((len(text), len(text) + len(p)))
            text += p + (joint if i + 1 < len(parts) else "")
        text += "\n\n"
    assert units(text) == want, [text[a:b] for a, b in units(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("가나다. ?!…\n\"'“”‘’()「」。、aB1,ก ข।-•")), max_size=80))
def test_units_cover_all_text(text):
    got = units(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    inside = {i for a, b in got for i in range(a, b)}
    assert all(i in inside or c.isspace() for i, c in enumerate(text))


@pytest.mark.parametrize(
    "text, want",
    [
        ("1. 서류\n  - 진단서\n  - 영수증. 사본\n2. 접수", ["1. 서류", "- 진단서", "- 영수증. 사본", "2. 접수"]),
        ("1. 서류\n가. 진단서\n   계속\n나. 영수증\n2. 접수\n가. 창구", ["1. 서류", "가. 진단서\n   계속", "나. 영수증", "2. 접수", "가. 창구"]),
        ("- 가\n  - 나\n    ① 다\n  - 라\n- 마", ["- 가", "- 나", "① 다", "- 라", "- 마"]),
        ("다음 서류를 냅니다\n1. 진단서\n2. 영수증", ["다음 서류를 냅니다", "1. 진단서", "2. 영수증"]),
        ("1. 약관\n(3) 항을 따름\n2. 끝", ["1. 약관\n(3) 항을 따름", "2. 끝"]),
    ],
)
def test_list_levels(text, want):
    assert [text[a:b] for a, b in units(text)] == want


def test_sentence_table(spark):
    docs = spark.createDataFrame([(1, "가. 나다 라.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (5, "끝났습니다. " * 5_000, 5), (5, "끝", 5), (None, "x", 5)], "doc_id long, text string, start_char int")
    got = sentence_units(docs)
    assert got.where("doc_id = 5").count() == 5_001 and got.where("doc_id in (2, 3, 4)").count() == 0
    assert sentence_units(docs.limit(0)).count() == 0


def test_nested_and_introduced_lists():
    shown = lambda t: [t[a:b] for a, b in units(t)]
    assert shown("- a\n1. b\n2. c\n- d") == ["- a", "1. b", "2. c", "- d"]
    assert shown("Items:\n1. one\n2. two") == ["Items:", "1. one", "2. two"]


def test_automaton_takes_linear_time():
    import time

    for part in ("([{", ")]}", "2024. 1. 2. ", "a.b.", '" a', "ข้อ 12 "):
        began = time.time()
        units(part * 20_000)
        assert time.time() - began < 10
