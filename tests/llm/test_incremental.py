"""Batches against history."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverline.llm import incremental as I

SCHEMA = "row_id long, artifact_id long, product_name string, contract_name string, benefit_name string, amount string, amount_condition string, trigger string, notes_summary string"
BASE = "보험기간 중 피보험자가 위암(분류코드 C16) 상태로 인하여 수술을 받았을 때 (최초 2회에 한함)"


@pytest.fixture(scope="module")
def tables(spark):
    syn = spark.createDataFrame([(1, "action", 1, "수술", "수술비", 0), (2, "disease", 2, "위암", "위장암", 0)], "syn_id long, slot string, label_id long, label string, variant string, ord long")
    cat = spark.createDataFrame([(1, "위암 수술비", "위암", "수술")], "canonical_id long, canonical_name string, disease string, action string")
    art = spark.createDataFrame([(1, 1, "ab12"), (2, 2, "SHA256:AB12 "), (3, 3, "cd"), (4, 3, ""), (5, 2, None), (6, None, "ab12"), (7, 1, "ab12")], "artifact_id long, batch_no long, file_hash string")
    return art, syn, cat


def rows(spark):
    r = lambda i, a, benefit="위암 수술비", amount="1억원", trig=BASE, cond="1년 이내": (i, a, "P", "C", benefit, amount, cond, trig, None)
    return spark.createDataFrame([
        r(1, 1), r(2, 2), r(3, 2, "위장암수술비", "100백만원"), r(4, 3, trig=BASE.replace("중", "동안").replace("인하여", "말미암아").replace("받았을 때", "받은 경우")),
        r(5, 3, trig=BASE.replace("2회", "3회")), r(6, 3, amount="2억원"), r(7, 1), r(8, 3, trig=BASE.replace("수술을", "수-\n술을\n- 12 -\n").replace("C16", "C1б".replace("б", "6"))),
        r(9, 3, trig=None), r(10, 99), r(11, 2, trig="치매 상태로 진단 확정되어 C16 전혀 다른 글 2회"), r(12, 3, trig="치매 상태로 진단 확정되어 C16 전혀 다른 글 2회"), (13, 3, None, None, None, None, None, None, None), (14, 3, "P", "C", "위암 수술비", "1억원", "1년 이내", BASE + "".join(chr(0xAC00 + 7 * k) for k in range(1500)), None),
    ], SCHEMA)


def test_found(spark, tables):
    extra = rows(spark).withColumns({c: F.lit(1) for c in ("key", "sig", "block", "record", "batch", "won")})
    got = {tuple(r) for r in I.repeats_found(extra, *tables).collect()}
    assert {x for x in got if x[0] == "artifact"} == {("artifact", 1, 2)}
    assert {x for x in got if x[0] == "row"} == {("row", 1, i) for i in (2, 3, 4, 8)} | {("row", 11, 12)}


def test_empty_and_single_batch(spark, tables):
    assert I.repeats_found(rows(spark).limit(0), *tables).where("kind = 'row'").count() == 0
    assert I.repeats_found(rows(spark).where("artifact_id = 1"), *tables).where("kind = 'row'").count() == 0


def test_agreement_follows_similarity(spark):
    texts = ["가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허", "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼호", "완전히다른글자들로이루어진문장입니다그렇습니다", "", ""]
    sig = I.signatures(texts)
    df = spark.createDataFrame([(*map(int, sig[i]), *map(int, sig[j])) for i, j in ((0, 1), (0, 2), (3, 4))], "sa long, sb long, ra long, rb long")
    got = [r[0] for r in df.select(I.agreement()).collect()]
    assert got[0] >= 12 and got[1] < I.SIMILAR and got[2] == I.BINS
    assert got == [agree(sig[i], sig[j]) for i, j in ((0, 1), (0, 2), (3, 4))]
    assert I.signatures([]).shape == (0, 2) and sig.dtype == np.int64


def agree(a, b) -> int:
    return int((np.array(a, dtype=np.int64).view(np.uint8) == np.array(b, dtype=np.int64).view(np.uint8)).sum())


def signed(values) -> tuple[int, int]:
    return tuple(int(x) for x in np.array(values, dtype=np.uint8).view(np.int64))


def batch(spark, *variants):
    """Variants (rid, part, 16 values)."""
    return spark.createDataFrame([(bytes([p]) * 16, p, *signed(v), i) for i, p, v in variants], "part binary, check long, sa long, sb long, rid long")


def accepted(h, df) -> dict:
    return {r.rid: r.record for r in h.accept(df).collect()}


#: Values of which neighbours agree in eight, others in none.
CHAIN = {k: [20 * k + i for i in range(8)] + [20 * (k + 1) + i for i in range(8)] for k in range(2, 6)}
CHAIN = {k: v if k % 2 == 0 else v[8:] + v[:8] for k, v in CHAIN.items()}
FIRST = [200 + i for i in range(16)]


def test_history_is_persisted(spark):
    h = I.History(spark)
    assert accepted(h, batch(spark, (1, 7, FIRST), (3, 8, FIRST))) == {1: 1, 3: 3}
    again = I.History(spark, h.path, h.runs, tuple(h.kinds))
    assert accepted(again, batch(spark, (4, 7, FIRST), (5, 7, CHAIN[2]), (6, 9, FIRST), (7, 7, CHAIN[2][:12] + [1, 2, 3, 4]))) == {4: 1, 5: 5, 6: 6, 7: 5}
    last = I.History(spark, h.path, again.runs, tuple(again.kinds))
    assert accepted(last, batch(spark, (8, 7, CHAIN[2]), (9, 9, FIRST))) == {8: 5, 9: 6}


def test_chains_are_followed_to_their_record(spark):
    """Variants of which only neighbours agree, below a first record unlike all of them: in one batch and in a batch each."""
    assert agree(signed(CHAIN[2]), signed(CHAIN[3])) == 8 and agree(signed(CHAIN[2]), signed(CHAIN[4])) == 0 and agree(signed(FIRST), signed(CHAIN[2])) == 0
    want = {1: 1, 2: 2, 3: 2, 4: 2, 5: 2}
    assert accepted(I.History(spark), batch(spark, (1, 7, FIRST), *[(k, 7, CHAIN[k]) for k in (2, 3, 4, 5)])) == want
    h, got = I.History(spark), {}
    for df in [batch(spark, (1, 7, FIRST)), *[batch(spark, (k, 7, CHAIN[k])) for k in (2, 3, 4, 5)]]:
        got |= accepted(h, df)
    assert got == want


def test_variants_behind_an_unlike_leader(spark):
    """All share one value with the least, which is unlike them; two of them are alike."""
    one = lambda *xs: [9, *xs]
    a, b, c = one(*range(30, 45)), one(*range(60, 75)), one(*range(60, 74), 99)
    assert accepted(I.History(spark), batch(spark, (1, 7, FIRST), (2, 7, a), (3, 7, b), (4, 7, c))) == {1: 1, 2: 2, 3: 3, 4: 3}


def test_equal_hash_with_other_check_is_another_part(spark):
    df = spark.createDataFrame([(b"x" * 16, 1, *signed(FIRST), 1), (b"x" * 16, 2, *signed(FIRST), 2)], "part binary, check long, sa long, sb long, rid long")
    assert accepted(I.History(spark), df) == {1: 1, 2: 2}


def test_only_buckets_that_are_hit_are_read(spark):
    h = I.History(spark, buckets=16)
    big = spark.range(2_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("part"), F.xxhash64("id").alias("check"), F.lit(1).cast("long").alias("sa"), F.lit(2).cast("long").alias("sb"), F.col("id").alias("rid"))
    h.accept(big)
    probe = big.where("rid = 5").withColumn("rid", F.lit(9_000).cast("long"))
    hit = [r[0] for r in probe.select(h.bucket()).collect()]
    read = h.keys("parts", hit)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert read.count() < 250 and files(read) == 1 < files(h.keys("parts", list(range(16))))
    assert accepted(h, probe) == {9_000: 5}


def test_equal_to_brute_force_over_tables(spark, small):
    t = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    tables = [t(n) for n in ("summary_rows", "artifacts", "synonyms", "benefit_catalog")]
    known, members = {}, {}
    for r in sorted(I.row_features(*tables).collect(), key=lambda r: (r.batch_no, r.row_id)):
        sig = (r.sa, r.sb)
        seen = known.setdefault((bytes(r.part), r.check), [])
        record = next((i for i, s in seen if agree(s, sig) >= I.SIMILAR), r.row_id)
        seen.append((record, sig))
        members.setdefault(record, []).append((r.row_id, r.batch_no))
    want = set()
    for rows_of in members.values():
        a = min(rows_of)
        want |= {(a[0], i) for i, b in rows_of if b > a[1]}
    got = {(r.id_a, r.id_b) for r in I.repeats_found(*tables).where("kind = 'row'").collect()}
    assert got == want and len(want) > 10


def one_by_one(rows) -> dict:
    """Record of every (batch_no, rid, part, values): that of the earliest row of its part it is like."""
    seen, want = {}, {}
    for b, i, p, v in sorted(rows):
        want[b, i] = next((r for r, x in seen.setdefault(p, []) if agree(signed(v), signed(x)) >= I.SIMILAR), i)
        seen[p].append((want[b, i], v))
    return want


def test_batches_accepted_together_equal_one_after_another(spark):
    """Random signatures with few different values, so that most are unlike their first record and chains are long; ids don't follow batches."""
    rng = np.random.default_rng(5)
    ids = rng.permutation(600)
    rows = [(int(rng.integers(1, 5)), int(i), int(rng.integers(0, 4)), rng.integers(0, 8, 16).tolist()) for i in ids]
    rows += [(b % 4 + 1, 1000 + i, p, v) for b, i, p, v in rows[:100]]
    want = one_by_one(rows)
    df = spark.createDataFrame([(bytes([p]) * 16, p, *signed(v), i, b) for b, i, p, v in rows], "part binary, check long, sa long, sb long, rid long, batch_no long")
    read = lambda out: {(r.batch_no, r.rid): r.record for r in out.collect()}
    assert read(I.History(spark).accept(df)) == want and len(set(want.values())) > 20
    h, got = I.History(spark), {}
    for b in (1, 2, 3, 4):
        got |= read(h.accept(df.where(F.col("batch_no") == b)))
    assert got == want


def test_pairs_lose_no_similar_signature():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 6, (400, I.BINS)).astype(np.uint8)
    group = np.arange(400) // 100
    want = [next((j for j in range(i // 100 * 100, i) if (values[i] == values[j]).sum() >= I.SIMILAR), i) for i in range(400)]
    assert I.earliest_alike(group, values, np.arange(400)).tolist() == want
    assert all(any(j in four and k in four for j, k in I.PAIRS) for four in combinations(range(I.BINS), I.SIMILAR))


def test_steps_do_not_grow_with_batches(spark, tables):
    """Accepting twelve batches takes as many jobs as accepting one."""
    sc, rows_of = spark.sparkContext, lambda n: spark.createDataFrame([(bytes([i]) * 16, i, *signed(v), 10 * i + b, b) for i in range(5) for b in range(n) for v in (FIRST if b == 0 else CHAIN[2 + b % 4],)], "part binary, check long, sa long, sb long, rid long, batch_no long")

    def jobs(n: int) -> int:
        sc.setJobGroup(f"batches-{n}", "")
        I.History(spark).accept(rows_of(n)).count()
        sc.setJobGroup("", "")
        return len(sc.statusTracker().getJobIdsForGroup(f"batches-{n}"))

    assert 0 < jobs(12) <= jobs(2) + 3


def test_query_accepts_all_batches_at_once(spark, tables, monkeypatch):
    accept, calls = I.History.accept, []
    monkeypatch.setattr(I.History, "accept", lambda self, *a: calls.append(1) or accept(self, *a))
    assert I.repeats_found(rows(spark), *tables).where("kind = 'row'").count() == 5
    assert len(calls) == 1  # the three batches of the fixture were a call each, of some ten jobs each
