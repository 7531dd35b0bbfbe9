"""Operators against fixtures and plain models."""

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coverline.functions.lexicon import canonical_key
from coverline.operators import catalog, collapse, compare, flatten, gaps, layout, matching, report
from coverline.plans.comparison import compare_sides
from coverline.sources import artifacts as src
from coverline.sources import providers

DETAIL = "ord long, insurer string, product_name string, contract_name string, benefit_name string, renewal_type string, coverage_limit string, trigger string, amount string, amount_condition string, reduction_note string"


def details(spark, rows):
    return spark.createDataFrame([(i, "A", "P", "C", *r) for i, r in enumerate(rows)], DETAIL)


def test_flatten_and_export(spark):
    c = lambda name, benefits, code="": (name, "rider", code, "1,000만원", "s.pdf", benefits, ["주1", "주2"])
    one = c("특약(비갱신형)", [(["가", "나"], "암 (최초 1회)", [("100만원", "1년 이내", ""), ("200만원", "1년 후", "")]), ([], "t", [])])
    df = spark.createDataFrame([(1, "I", "P", [one], [([one], None), (None, c("둘", [(["다"], None, None)]))])], f"ord int, insurer string, product_name string, contracts array<{flatten.CONTRACT}>, riders array<struct<contracts:array<{flatten.CONTRACT}>,contract:{flatten.CONTRACT}>>")
    flat = flatten.all_contracts(df)
    assert sorted(r.c.name for r in flat.collect()) == ["둘", "특약(비갱신형)"]
    ben = flatten.benefit_rows(flat)
    assert sorted(r.benefit_name for r in ben.collect()) == ["", "가", "나", "다"]
    rows = flatten.detail_rows(ben).collect()
    assert len(rows) == 6 and {r.renewal_type for r in rows if r.contract_name != "둘"} == {"비갱신형"}
    two = [r for r in rows if r.benefit_name == "가"]
    assert [len(json.loads(r.amount_detail)) for r in two] == [2, 2] and two[0].coverage_limit == "최초 1회" and two[0].notes_summary == "주1 | 주2"


def test_dedupe_key(spark):
    row = ("가생명", "P", "특약", "급부", "3,000만원", None, "사유" * 300, "t.pdf")
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in flatten.KEY_FIELDS))
    want = hashlib.md5("|".join((x or "")[:200] if i == 6 else x or "" for i, x in enumerate(row)).encode()).hexdigest()[:16]
    assert df.select(flatten.dedupe_key()).first()[0] == want


def test_first_per_is_stable(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, "b", "y")], "ord int, k string, v string")
    assert sorted((r.k, r.ord) for r in flatten.first_per(df, ["k"], ["ord"]).collect()) == [("a", 1), ("b", 2)]
    assert sorted(flatten.first_per(df, ["k"], ["ord"]).collect()) == sorted(flatten.first_by_window(df, ["k"], ["ord"]).collect())


def test_collapse(spark):
    rows = [("소액질병진단자금", "", "", t, a, c, "") for t in ("기타피부암", "갑상선암") for a, c in (("100만원", "1년미만"), ("200만원", "1년이상"))]
    got = collapse.comparison_rows(details(spark, rows)).collect()
    assert len(got) == 1 and got[0].detail_row_count == 4 and len(got[0].triggers) == 2 and len(json.loads(got[0].amount_detail)) == 4
    assert got[0].trigger == "기타피부암" and got[0].amount == "100만원"
    assert collapse.comparison_rows(details(spark, rows).limit(0)).count() == 0
    repeated = details(spark, rows + rows)
    assert collapse.comparison_rows(repeated).first().detail_row_count == 8


def model_pairs(our, comp):
    """Plain greedy pairing."""

    def sim(a, b):
        if a == b:
            return 1.0
        return len(set(a) & set(b)) / max(len(set(a)), len(set(b))) if a and b else 0.0

    ours, comps, out = defaultdict(list), defaultdict(list), set()
    for o, k, a in our:
        ours[k].append((o, a))
    for o, k, a in comp:
        comps[k].append((o, a))
    for k in {*ours, *comps}:
        free = sorted(comps[k])
        for o, a in sorted(ours[k]):
            best = max(free, key=lambda c: (sim(a, c[1]), -c[0]), default=None)
            if best:
                free.remove(best)
            out.add((k, o, best[0] if best else None))
        out |= {(k, None, c) for c, _ in free}
    return out


def test_pairing_equals_model(spark):
    rng = random.Random(5)
    make = lambda n: [(i, rng.choice("xyz"), rng.choice(["", "100만원", "200만원", "3억", "50만원"])) for i in range(n)]
    our, comp = make(40), make(30)
    frame = lambda rows: spark.createDataFrame(rows, "ord long, key string, amount string")
    got = {(r.key, r.our_ord, r.comp_ord) for r in matching.paired(frame(our), frame(comp)).collect()}
    assert got == model_pairs(our, comp)
    c = matching.match_counters(frame(our), frame(comp)).first()
    assert (c.matched, c.our_only, c.comp_only) == (sum(o is not None and x is not None for _, o, x in got), sum(x is None for _, _, x in got), sum(o is None for _, o, _ in got))
    assert matching.paired(frame(our).limit(0), frame(comp).limit(0)).count() == 0


def test_comparison(spark):
    our = details(spark, [("갑상선암 진단자금", "", "", "t", "1,000만원", "", ""), ("일반암진단자금", "", "", "t", "1,500만원", "1년 이내", ""), ("일반암진단자금", "", "", "t", "3,000만원", "1년 이후", ""), ("암수술급여금", "", "", "t", "500만원", "", ""), ("로봇수술자금", "", "", "t", "200만원", "", "")])
    comp = details(spark, [("갑상선암진단보험금", "", "", "t", "500만원", "", ""), ("암진단보험금", "", "", "t", "3,000만원", "", ""), ("암수술자금", "", "", "t", "500만원", "", ""), ("암입원급여금", "", "", "t", "10만원", "", "")])
    keyed = lambda df: collapse.comparison_rows(df).withColumn("key", canonical_key("benefit_name"))
    t = compare_sides(keyed(our), keyed(comp))
    verdicts = {(r.our_name, r.comp_name): (r.advantage, r.rationale) for r in t["pairs"].collect()}
    assert verdicts[("갑상선암 진단자금", "갑상선암진단보험금")] == ("당사우위", "금액↑")
    assert verdicts[("일반암진단자금", "암진단보험금")] == ("타사우위", "조건없음 (당사(1년이내 / 1년이후))")
    assert verdicts[("암수술급여금", "암수술자금")] == ("동일", "")
    assert verdicts[("로봇수술자금", "")][0] == "당사단독" and verdicts[("", "암입원급여금")][0] == "타사단독"
    s = t["summary"].first()
    assert (s.matched, s.our_only, s.comp_only, s["diff"], s.total) == (3, 1, 1, 2, 5)
    cov = {r.disease: (r.our, r.comp, r.matched_pairs, r.matched) for r in t["coverage"].collect()}
    assert cov["갑상선암"] == (1, 1, 1, 2) and cov["일반암"] == (2, 3, 2, 4) and cov["기타"] == (1, 0, 0, 0)
    p = t["position"].first()
    assert (p.position, p.our_share, p.comp_share) == ("혼재", 33, 33)
    assert [(r.name, r.gap_pct) for r in t["gaps"].collect()] == [("갑상선암 진단자금", 100), ("일반암진단자금", -50)]
    assert {r.type for r in t["points"].collect()} == {"strength", "weakness", "gap"}
    assert {r.side: (r.total, r.alone, r.names) for r in t["facts"].collect()} == {"our": (4, 1, "로봇수술자금"), "comp": (4, 1, "암입원급여금")}
    lines = report.markdown(t["pairs"], keyed(our), keyed(comp), t["points"]).collect()
    assert {r.section for r in lines} >= {1, 2, 3, 5}


def test_catalog(spark):
    a = spark.createDataFrame([(1, "k1"), (2, "k2")], "ord long, dedupe_key string").withColumns({c: F.lit("x") for c in flatten.KEY_FIELDS})
    b = spark.createDataFrame([(1, "k2"), (2, "")], "ord long, dedupe_key string").withColumns({c: F.lit("x") for c in flatten.KEY_FIELDS})
    assert catalog.load_all(a, b).count() == 3 and catalog.load_all(a, a).count() == 2
    assert {r.dedupe_key for r in catalog.upsert(a, b.where("dedupe_key = 'k2'")).collect()} == {"k1", "k2"}
    up = spark.createDataFrame([(1, "h"), (2, "h"), (3, ""), (4, None)], "i long, file_hash string")
    assert sorted(r.i for r in catalog.first_uploads(up, ["i"]).collect()) == [1, 3, 4]
    assert sorted(r.i for r in catalog.unseen(up, up.where("i = 1")).collect()) == [3, 4]
    assert catalog.in_context(a.withColumn("insurer", F.lit("x")), None).count() == 0
    data = bytes(range(256)) * 300
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(catalog.fingerprint("c"), catalog.fingerprint("c", None)).first()
    assert tuple(got) == (hashlib.sha256(data[:65_536]).hexdigest()[:32], hashlib.sha256(data).hexdigest()[:32])


def cells(spark, rows):
    return spark.createDataFrame([(1, 0, 1, i, j, t) for i, row in enumerate(rows) for j, t in enumerate(row)], "doc_id int, page_idx int, table_no int, row_no int, col_no int, text string")


def test_tables(spark):
    rows = [("급부명칭", "지급사유", "지급금액\n경과기간", ""), ("", "", "경과기간", ""), ("소액질병진단자금", "기타피부암", "1년미만", "100만원"), ("", "", "1년이상", "200만원"), ("", "갑상선암", "1년미만", "100만원"), ("", "", "1년이상", "200만원"), ("", "제자리암", "1년미만", "50만원"), ("", "", "1년이상", "100만원")]
    got = sorted(layout.table_benefits(cells(spark, rows)).collect(), key=lambda r: r.benefit_no)
    assert [(r.name, r.trigger, len(r.amounts)) for r in got] == [("소액질병진단자금", t, 2) for t in ("기타피부암", "갑상선암", "제자리암")]
    assert got[0].amounts[0].condition == "1년미만" and got[0].amounts[1].amount == "200만원"
    assert len(layout.table_benefits(cells(spark, rows), trigger_opens=False).collect()) == 1
    assert layout.table_benefits(cells(spark, [("a", "b", "c")] * 3)).count() == 0
    assert layout.quality(layout.table_benefits(cells(spark, rows)), ["doc_id"]).first().score == 1.0


def test_notes_and_sections(spark):
    blocks = spark.createDataFrame([(1, 0, 1, 50.0, 10.0, "□ 무배당 가 (선택특약)"), (1, 0, 2, 50.0, 20.0, "주) \n1. 첫\n째 2. 둘"), (1, 0, 3, 50.0, 30.0, "관리번호 X-1"), (1, 1, 4, 50.0, 5.0, "3. 셋"), (1, 1, 5, 50.0, 15.0, "- 2 형\n[기준 : 특약]"), (1, 1, 6, 50.0, 25.0, "4. 넷"), (1, 2, 7, 50.0, 5.0, "□ 무배당 나")], "doc_id int, page_idx int, block_no int, x0 double, y0 double, text string")
    assert [r.note for r in layout.block_notes(blocks).orderBy("note_no").collect()] == ["1. 첫째", "2. 둘", "3. 셋"]
    s = layout.sections(blocks).orderBy("start_page").collect()
    assert [(r.name, r.end_page) for r in s] == [("무배당 가", 2), ("무배당 나", 2**31 - 1)]
    pages = spark.createDataFrame([(1, 0, "머리\n주) 첫 주석입니다\n1. 하나입니다\n이어짐\n2 / 9\n2. 둘째입니다")], "doc_id int, page_idx int, text string")
    assert sorted(r.note for r in layout.line_notes(pages).collect()) == ["1. 하나입니다 이어짐", "2. 둘째입니다", "첫 주석입니다"]
    text = spark.createDataFrame([(1, 0, "암진단자금\n진단 확정시\n1,000만원\n수술자금 급부\n50%")], "doc_id int, page_idx int, text string")
    assert [(r.name, r.trigger, r.amount) for r in layout.text_benefits(text).orderBy("group_no").collect()] == [("암진단자금", "진단 확정시", "1,000만원"), ("수술자금 급부", "", "50%")]


def test_numbering_is_global(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "v int").repartition(7)
    got = report.numbered(df, ["v"], blocks=5).collect()
    assert sorted((r.evidence_no, r.v) for r in got) == [(i + 1, i) for i in range(500)]


def test_gaps(spark):
    rows = spark.createDataFrame([(1, "A", "암진단자금", "other"), (2, "B", "암진단보험금", "diagnosis"), (3, "A", "모름", "other"), (4, None, None, None)], "ord long, insurer string, benefit_name string, benefit_category string")
    assert [r.benefit_name for r in gaps.unmapped(rows).collect()] == ["모름"]
    assert [(r.key, r.insurer) for r in gaps.solo_keys(rows).collect()] == [("모름", "A")]
    assert gaps.other_share(rows).first().share == 0.5 and gaps.other_share(rows.limit(0)).first().share == 0.0


def test_artifacts(spark, tmp_path):
    row = {"insurer": "A", "benefit_name": "가", "amount": "1만원"}
    (tmp_path / "a.json").write_text(json.dumps({"_meta": {"company_name": "A", "file_hash": "h"}, "rows": [row, row]}, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"_meta": {"file_hash": "h"}, "rows": [row]}))
    (tmp_path / "c.json").write_text(json.dumps([row]))
    (tmp_path / "d.json").write_text("no json")
    got = src.artifact_rows(src.read_artifacts(spark, str(tmp_path)))
    assert got.count() == 3
    assert src.prebuilt(spark, str(tmp_path / "none")).count() == 0
    src.write_catalog(got.select("insurer", "benefit_name"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_providers(spark):
    rows = spark.createDataFrame([(1, "A", "가", None), (2, "A", "나", '{"x":1}'), (3, "A", "가", None)], "ord long, insurer string, benefit_name string, slots string")
    full = rows.withColumns({c: F.lit("") for c in ("trigger", "amount", "amount_condition")})
    assert [r.slots for r in providers.enrich(full).orderBy("ord").collect()] == [None, '{"x":1}', None]
    ask = providers.first_answer([lambda p: None, lambda p: 'sure: [{"payment_freq": "매월"}] done'])
    filled = [r.slots for r in providers.enrich(full.coalesce(1), ask).orderBy("ord").collect()]
    assert json.loads(filled[0]) == {"payment_freq": "매월"} and filled[2] is None
    assert [r.slots for r in providers.with_cached_slots(rows, rows.where("ord = 2")).orderBy("ord").collect()] == [None, '{"x":1}', None]
    bad = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    assert providers.blocks_of(bad).first().error


def test_streaming(spark, tmp_path):
    from coverline.streaming.intake import accepted, read_rows, write_rows

    (tmp_path / "in").mkdir()
    line = json.dumps({"insurer": "A", "benefit_name": "가", "received_at": "2024-01-01T00:00:00"})
    (tmp_path / "in" / "1.json").write_text(line + "\n" + line)
    for _ in range(2):
        write_rows(accepted(read_rows(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        (tmp_path / "in" / "2.json").write_text(line)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_scratch(spark):
    import os

    from coverline import session

    df = spark.range(10).withColumnRenamed("id", "v")
    kept = session.cut(df, "test")
    assert kept.count() == 10 and session.bounded(df).count() == 10 and session.bounded(df, 3).count() == 10
    path = session._SCRATCH[-1].removeprefix("file:")
    assert os.path.exists(path)
    session.clean_scratch(spark)
    assert not os.path.exists(path) and not session._SCRATCH


def test_better_reading(spark):
    schema = "doc_id int, name string, amounts array<struct<condition:string,amount:string,reduction_note:string>>"
    good, bare = [("", "1만원", "")], []
    tables = spark.createDataFrame([(1, "가", good), (2, "", bare), (3, "나", bare), (3, "다", bare)], schema)
    coords = spark.createDataFrame([(1, "x", good), (2, "y", good), (3, "", bare), (4, "z", good)], schema)
    got = {(r.doc_id, r.name) for r in layout.better_reading(tables, coords, ["doc_id"]).collect()}
    assert got == {(1, "가"), (2, "y"), (3, "나"), (3, "다"), (4, "z")}


def test_key_points(spark):
    pairs = spark.createDataFrame([("가|진단", "matched", 1, 10, "a", "b", "1,000만원", "500만원", "당사우위", ""), ("가|수술", "our_only", 2, None, "c", "", "", "", "당사단독", ""), ("나|입원", "comp_only", None, 11, "", "d", "", "", "타사단독", "")], "key string, match_type string, our_ord long, comp_ord long, our_name string, comp_name string, our_amount string, comp_amount string, advantage string, rationale string")
    slots = spark.createDataFrame([(1, 10, "a", "payment_limit", "최대 2회", "최대 1회", "당사우위")], "our_ord long, comp_ord long, our_name string, dimension string, our_value string, comp_value string, advantage string")
    got = {r.ord: (r.type, r.n, r.detail) for r in compare.key_points(pairs, slots).collect()}
    assert got == {1: ("strength", 1, "a (1,000만원 vs 500만원, +100%)"), 2: ("strength", 1, "수술 1건"), 3: ("strength", 1, "지급한도 1건 / 감액조건 0건"), 6: ("gap", 1, "입원 1건")}


def _greedy(ours, comps):
    """Each of ours in order takes the unused one with the most similar amount, worked out pair by pair."""
    free, out = sorted(comps), []
    like = lambda a, b: 1.0 if a == b else 0.0 if not a or not b else len(set(a) & set(b)) / max(len(set(a)), len(set(b)))
    for o, amount in sorted(ours):
        best = max(free, key=lambda c: (like(amount, c[1]), -c[0]), default=None)
        if best:
            free.remove(best)
        out.append((o, best and best[0]))
    return set(out) | {(None, c[0]) for c in free}


@pytest.mark.parametrize("seed", range(3))
def test_pairing_equals_the_plain_greedy_choice(spark, seed):

    rng = random.Random(seed)
    draw = lambda n: [(i, rng.choice(["", "100만원", "10만원", "1,000만원", "500만원", "30%", "50만원"])) for i in rng.sample(range(1_000), n)]
    sides = {k: (draw(rng.randint(0, 40)), draw(rng.randint(0, 40))) for k in "abcdef"}
    frame = lambda j: spark.createDataFrame([(1_000 * n + i, k, a) for n, (k, s) in enumerate(sides.items()) for i, a in s[j]], "ord long, key string, amount string")
    got = {(r.key, r.our_ord, r.comp_ord) for r in matching.paired(frame(0), frame(1)).collect()}
    at = lambda n, x: None if x is None else 1_000 * n + x
    assert got == {(k, at(n, o), at(n, c)) for n, (k, s) in enumerate(sides.items()) for o, c in _greedy(*s)}


def test_pairing_of_one_hot_key(spark):
    side = lambda n, shift: spark.range(n).select(F.col("id").alias("ord"), F.lit("k").alias("key"), F.concat(((F.col("id") + shift) % 7 + 1).cast("string"), F.lit("만원")).alias("amount"))
    got = matching.match_counters(side(100_000, 0), side(90_000, 3)).first()
    assert (got.matched, got.our_only, got.comp_only) == (90_000, 10_000, 0)
    pairs = matching.paired(side(100_000, 0), side(90_000, 3)).groupBy("match_type").count().collect()
    assert {r.match_type: r["count"] for r in pairs} == {"matched": 90_000, "our_only": 10_000}


@pytest.mark.parametrize("name,kind,want", [("일반암수술급여금", "암보험", "surgery"), ("갑상선암진단비", "암보험", "diagnosis"), ("갑상선암 진단비", "암보험", "other"), ("보험료 면제", "default", "premium_waiver")])
def test_category_keywords(spark, name, kind, want):
    from coverline.functions.classify import benefit_category

    df = spark.createDataFrame([(name, "", kind)], "n string, t string, k string")
    assert df.select(benefit_category("n", "t", F.col("k"))["category"]).first()[0] == want
