"""Mapping of free-entered values."""

import random

import pytest
from pyspark.sql import functions as F

from coverline.llm import mapping as M

CATALOG = [(1, "위암 진단비", "위암", "진단"), (2, "위암 수술비", "위암", "수술"), (3, "갑상선암 재진단비", "갑상선암", "재진단"), (4, "로봇 Type Ⅱ 수술비", "로봇 Type Ⅱ", "수술"), (5, "폐렴 통원비", "폐렴", "통원")]
SYNONYMS = [
    (1, "action", 1, "진단", "진단비", 0), (2, "action", 1, "진단", "확진비", 1), (3, "action", 2, "수술", "수술비", 0), (4, "action", 3, "재진단", "재진단비", 0), (5, "action", 4, "통원", "통원비", 0),
    (6, "disease", 10, "위암", "위장암", 0), (7, "disease", 11, "갑상선암", "갑상샘암", 0), (8, "disease", 12, "폐렴", "세균성폐렴", 0),
    (20, "disease", None, None, "이장암", 0), (21, "action", None, None, "싸발비", 0), (22, "action", None, None, None, 0), (23, "disease", None, None, "stomach cancer", 0), (24, "action", None, None, "수술뷔", 0),
]
CASES = [
    ("위암 진단비 ", 1), ("위장암확진비", 1), ("수술비 - 위암", 2), ("갑상샘암 재단진비", 3), ("갑상선암재징단비", 3), ("신)위암 수술비(1회한)", 2), ("위암에 대한 진단비", 1), ("위​암 진­단비", 1),
    ("dnldka wlsekstql", 1), ("dnldka wlseksql", 1), ("DNLDKA WLSEKSQL", 1), ("stomach cancer 수술비", 2), ("stomach cancer진단비", 1), ("stomach cancer집도비", 2), ("肺癌진단비", -1), ("로뵷 Type Ⅱ 수술비", 4), ("폐렴 진단비", -1), ("위암 도시락비", -1), ("멀미 진단비", -1), ("???", -1),
    ("진단진단비위암", -1), ("위암 진단단비", 1), ("폐렴 통원비", 5), ("가" * 5_000, -1),
]


@pytest.fixture(scope="module")
def tables(spark):
    cat = spark.createDataFrame(CATALOG, "canonical_id long, canonical_name string, disease string, action string")
    syn = spark.createDataFrame(SYNONYMS, "syn_id long, slot string, label_id long, label string, variant string, ord long")
    named = [(i, n, None) for i, (n, _) in enumerate(CASES)] + [(900, "위암 진단비", None), (901, None, None), (902, "", "위암"), (903, " \t", ""), (904, "위장암확진비", None)]
    # triggers that show what words mean: known names, then unknown words with them, then one that goes with anything
    triggers = [(1000 + i, n, f"{i}년 이후 {c}의 사유로 {a} 경우") for i in range(12) for n, c, a in (("위암 수술비", "위암(C16)", "수술을 받은"), ("폐렴 통원비", "폐렴(J18)", "외래로 통원한"), ("위암 진단비", "위암(C16)", "진단 확정된"))]
    unknown = [(2000 + i, n, f"{i}일 이후 {c}의 사유로 {a} 경우") for i in range(6) for n, c, a in (("stomach cancer 수술비", "위암(C16)", "수술을 받은"), ("위암 집도비", "위암(C16)", "수술을 받은"), ("위암 도시락비", "입냄새(Z99)", ("수술을 받은", "외래로 통원한", "진단 확정된")[i % 3]))]
    rows = spark.createDataFrame(named + triggers + unknown, "row_id long, benefit_name string, trigger string")
    return rows, syn, cat


def test_found(tables):
    rows, syn, cat = tables
    extra = rows.withColumns({c: F.lit(1) for c in ("key", "ref", "slot", "text", "target_id", "len")})
    found = M.mapping_found(extra, syn, cat).collect()
    got = {(r.src, r.item_id): r.target_id for r in found if r.item_id < 1000}
    assert {r.target_id for r in found if r.item_id >= 2000} == {2, -1}
    assert {k[1]: v for k, v in got.items() if k[0] == "row"} == {**{i: t for i, (_, t) in enumerate(CASES)}, 904: 1}
    assert {k[1]: v for k, v in got.items() if k[0] == "variant"} == {20: 10, 21: -1, 22: -1, 23: 10, 24: 2}


def test_without_triggers_unknown_words_stay_unknown(tables):
    rows, syn, cat = tables
    got = {r.item_id: r.target_id for r in M.mapping_found(rows.drop("trigger"), syn, cat).where("src = 'row'").collect()}
    assert all(got[i] == (-1 if "stomach" in n else t) for i, (n, t) in enumerate(CASES))


def test_several_edits_never_replace_a_short_word(spark):
    r = spark.createDataFrame([("s", "mri검사비", 1)], "slot string, t string, target_id long").select("slot", M.letters(F.col("t")).alias("ref"), "target_id")
    v = spark.createDataFrame([("s", t, t) for t in ("ami검사비", "mri검사빔", "mr검사비")], "slot string, key string, text string").select("slot", "key", M.letters(F.col("text")).alias("spelling"), F.lit(0).alias("slip"))
    assert {x.key for x in M.nearest(v, r).collect()} == {"mri검사빔", "mr검사비"}


def test_empty(tables):
    rows, syn, cat = tables
    assert M.mapping_found(rows.limit(0), syn, cat).where("src = 'row'").count() == 0
    assert M.mapping_found(rows, syn.limit(0), cat.limit(0)).where("target_id >= 0").count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, None])
def test_pigeonhole_join_misses_nothing(spark, k):
    """Against levenshtein over all pairs, with k edits or the budget of each reference."""
    rng = random.Random(k or 7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 11)))
    refs = [(f"{word()}", i) for i in range(60)]
    values = [word() for _ in range(80)]
    r = spark.createDataFrame([("s", w, i) for w, i in refs], "slot string, ref string, target_id long")
    v = spark.createDataFrame([("s", w, w, 0) for w in set(values)], "slot string, key string, spelling string, slip int")
    got = {x.key for x in (M.nearest(v, r) if k is None else M.nearest(v, r, F.lit(k), k)).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    assert got == {w for w in values if any(lev(w, x) <= (min(len(x) // M.LETTERS_PER_EDIT, M.MOST_EDITS) if k is None else k) for x, _ in refs)}
