"""Containers and mixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverline.llm import mixing as X
from coverline.llm import packing as P
from coverline.llm.tokens import TOKENIZERS, count_tokens, encoder, token_counts

pytest.importorskip("tiktoken")


def reference_pack(sizes, capacity):
    """The sum-of-squares rule worked out from scratch for every placement."""
    bins, out = [], []
    for s in sizes:
        if s >= capacity:
            bins.append(capacity)
            out.append(len(bins) - 1)
            continue

        def squares(levels):
            n = np.bincount([x for x in levels if x < capacity], minlength=capacity)
            return int((n**2).sum())

        best = None
        for level in sorted({b for b in bins if b + s <= capacity}):
            i = next(j for j in range(len(bins) - 1, -1, -1) if bins[j] == level)
            score = (squares([*bins[:i], level + s, *bins[i + 1 :]]), level + s != capacity)
            if best is None or score[0] < best[0][0] or (score[0] == best[0][0] and score[1] < best[0][1]):
                best = (score, i)
        new = squares([*bins, s])
        if best is None or best[0][0] > new:
            bins.append(s)
            out.append(len(bins) - 1)
        else:
            bins[best[1]] += s
            out.append(best[1])
    return bins, out


@pytest.mark.parametrize("seed", range(6))
def test_pack_follows_the_rule(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 21, 120)
    got = P.pack(sizes, 20)
    used = np.bincount(got, weights=sizes)
    assert used.max() <= 20 and used.sum() == sizes.sum() and set(got) == set(range(got.max() + 1))
    bins, _ = reference_pack(sizes.tolist(), 20)
    assert abs(len(bins) - len(used)) <= 2
    assert len(used) <= np.ceil(sizes.sum() / 20) * 1.15 + 2


def docs(spark, n=60):
    rows = [(i, "보험금 지급 " * (i % 17 + 1), "ab"[i % 2]) for i in range(n)] + [(1000, "긴 글 " * 3_000, "a"), (1001, None, "a"), (1002, "", "b"), (1003, "null source", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("container", "shard", "capacity", "block")})


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(1, 64), (2, 512), (3, 0), (None, 5)], "pack_id long, capacity_tokens long")


@pytest.mark.parametrize("shard", [1_000_000, 10])
def test_containers(spark, sizes, shard):
    d = docs(spark)
    got = P.containers(d, sizes, shard).toPandas()
    tokens = token_counts(d).toPandas().set_index("doc_id").n_tokens
    assert set(got.pack_id) == {1, 2}
    for pack, cap in ((1, 64), (2, 512)):
        g = got[got.pack_id == pack]
        assert (g.groupby("container_id").n_tokens.sum() <= cap).all()
        per = g.groupby("doc_id").n_tokens.sum()
        assert per.to_dict() == tokens[tokens > 0].to_dict()
        pieces = g.groupby("doc_id").size()
        assert all(n == -(-tokens[i] // cap) for i, n in pieces.items())
    fill = P.fills(P.containers(d, sizes, shard)).collect()
    assert all(r.fill > 0.75 and r.n_containers >= r.least_containers for r in fill)
    assert P.containers(d.limit(0), sizes, shard).count() == 0 and P.containers(d, sizes.where("pack_id = 3"), shard).count() == 0


def test_tokens_of_long_texts_are_whole(spark):
    enc = encoder(TOKENIZERS, "byte_bpe_multi_50k.tiktoken")
    text = "줄 하나입니다.\nanother line 12\n" * 4_000
    assert abs(count_tokens(text, enc) - len(enc.encode_ordinary(text))) <= len(text) // 20_000 + 1
    assert count_tokens(None, enc) == 0 and count_tokens("가" * 50_000, enc) > 0


@pytest.mark.parametrize("shards", [1, 7, 200])
def test_deal_is_exact_and_disjoint(shards):
    out = X.deal(np.array([1300, 0, 4000]), shards, 1)
    assert out.sum(axis=0).tolist() == [1300, 0, 4000] and max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 9
    assert (out == X.deal(np.array([1300, 0, 4000]), shards, 1)).all()


def test_ten_thousand_shards_are_dealt_in_executors(spark):
    got = X.dealt_blocks(spark, {1: {"a": 25_000, "b": 5_000}, 2: {"a": 3}}, {1: 10_000, 2: 2}, 5)
    assert len(X.subtrees(np.array([25_000, 5_000]), 10_000, 6)) <= 2**X.TOP
    rows = got.toPandas()
    assert {k: sorted(v) == list(range(1, n + 1)) for (k, v), n in zip(rows.groupby(["mix_id", "source"])["rank"], (25_000, 5_000, 3))} == {(1, "a"): True, (1, "b"): True, (2, "a"): True}
    per = rows[rows.mix_id == 1].groupby("shard").size()
    assert rows[rows.mix_id == 1].shard.nunique() > 9_900 and per.max() <= 12


def test_running_sums_over_ranges(spark):
    df = spark.range(1_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h"), F.col("id").alias("v"))
    got = X.running(df, ["k"], ["h"], "v", "s").toPandas().sort_values(["k", "h"])
    assert (got.groupby("k").v.cumsum() == got.s).all()


def test_mix(spark):
    d = docs(spark, 400)
    t = spark.createDataFrame([(1, "a", 0.7, 1), (1, "b", 0.3, 2), (2, "a", 0.2, 3), (2, "b", 0.5, 3), (2, "none", 0.3, 2), (3, "none", 1.0, 1), (4, None, 1.0, 1)], "mix_id long, source string, target_share double, max_repeats long")
    small = d.where("doc_id < 1000")
    sel = X.mixed(small, t)
    assert sel.where("mix_id in (3, 4)").count() == 0
    s = {(r.mix_id, r.source): r for r in X.shares(sel, t.where("source is not null")).collect()}
    for (m, src), r in s.items():
        assert r.most_uses <= r.max_repeats
        if src == "none":
            assert r.actual_share == 0
    assert abs(s[(1, "a")].actual_share - 0.7) < 0.02 and abs(s[(1, "b")].actual_share - 0.3) < 0.02
    assert abs(s[(2, "a")].actual_share / s[(2, "b")].actual_share - 0.4) < 0.04
    p = sel.toPandas()
    assert not p.duplicated(["mix_id", "doc_id", "repeat_no"]).any()
    assert (p.groupby(["mix_id", "shard"]).position.max() == p.groupby(["mix_id", "shard"]).size()).all()
    assert sorted(map(tuple, sel.collect())) == sorted(map(tuple, X.mixed(small, t).collect()))
    many = X.mixed(small, t, shard_tokens=200, block_docs=5)
    assert many.select("shard").distinct().count() > 20 and not many.toPandas().duplicated(["mix_id", "doc_id", "repeat_no"]).any()
    assert X.mixed(small.limit(0), t).count() == 0 and X.mixed(small, t.limit(0)).count() == 0
