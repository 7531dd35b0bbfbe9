"""Records of several sources mixed to target shares of the total size, by a splitting tree.

Every document of a listed source falls into one of the source's blocks by hash, one block for ``BLOCK_DOCS`` documents. A mix
may take a source's tokens at most ``max_repeats`` times, so its total is the largest at which no listed source that has
documents is asked for more; a source without documents gives nothing, which the report shows. Each source's quota is whole
passes over its blocks plus whole blocks of a last pass in permuted order plus one block taken in part. The drawn
blocks of all sources are then dealt to output shards by a tree: at every node the numbers of blocks still to place are
split in two by a multivariate hypergeometric draw, so each shard gets a random but exact share of every source and the
shards are disjoint; within a shard documents are put into random order.

The driver sees quotas only: sizes of sources, and the numbers of blocks at the upper ``TOP`` levels of the tree; the lower
levels are split in executors, from a seed of the node's own. Blocks are put in order and numbered by ranges, not in one task.

Defined results: a null source is no source; documents without tokens are never drawn; a source not in ``mix_targets``
is not used; shares that do not sum to one are scaled; a mix without any available source gives no rows; repeated
documents are documents of their own; empty tables give empty results; the draw depends on ``seed`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverline.llm.tokens import token_counts
from coverline.operators.ranges import running
from coverline.session import cut

#: Documents of a block, and the fewest blocks of a source.
BLOCK_DOCS, MIN_BLOCKS = 200, 8
#: Tokens of an output shard.
SHARD_TOKENS = 500_000
#: Levels of the tree that are split on the driver.
TOP = 6

Node = tuple[int, int, np.ndarray, np.ndarray]


def split(node: Node, seed: int) -> list[Node]:
    """The two halves of a node (first shard, last shard + 1, blocks of every source, blocks dealt before) by a hypergeometric draw from the node's own seed."""
    lo, hi, n, first = node
    mid = (lo + hi) // 2
    draw = int(round(int(n.sum()) * (mid - lo) / (hi - lo)))
    left = np.random.default_rng([abs(seed), lo, hi]).multivariate_hypergeometric(n, draw, method="marginals") if draw else np.zeros_like(n)
    return [(lo, mid, left, first), (mid, hi, n - left, first + left)]


def subtrees(counts: np.ndarray, shards: int, seed: int, levels: int = TOP) -> list[Node]:
    """The nodes after the upper levels of the tree."""
    nodes = [(0, shards, counts.astype(np.int64), np.zeros(len(counts), dtype=np.int64))]
    for _ in range(levels):
        nodes = [x for node in nodes for x in (split(node, seed) if node[1] - node[0] > 1 else [node])]
    return nodes


def leaves(node: Node, seed: int) -> Iterator[Node]:
    """The shards below a node."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node[1] - node[0] == 1:
            yield node
        else:
            stack += split(node, seed)


def deal(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) numbers of blocks: the tree of hypergeometric splits of ``counts`` over the shards."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    for node in subtrees(counts, shards, seed):
        for lo, _, n, _ in leaves(node, seed):
            out[lo] = n
    return out


def quotas(targets: list[tuple], totals: dict[str, int]) -> dict[str, float]:
    """Tokens to take of each available source of one mix: the largest total that respects every repeat limit."""
    known = [(s, share, reps) for s, share, reps in targets if share and share > 0 and reps and reps > 0 and totals.get(s, 0) > 0]
    if not known:
        return {}
    total = min(totals[s] * reps / share for s, share, reps in known)
    return {s: total * share for s, share, reps in known}


def dealt_blocks(spark, counts: dict[int, dict[str, int]], shards: dict[int, int], seed: int) -> DataFrame:
    """(mix_id, source, rank, shard): which shard of a mix the block of every rank goes to; the driver splits the top of the tree, executors the rest."""
    names = {m: sorted(c) for m, c in counts.items()}
    tops = [(m, lo, hi, n.tolist(), first.tolist(), names[m]) for m in counts for lo, hi, n, first in subtrees(np.array([counts[m][s] for s in names[m]]), shards[m], seed + m)]
    nodes = spark.createDataFrame(tops, "mix_id long, lo long, hi long, n array<long>, first array<long>, sources array<string>")

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mix, lo, hi, n, first, sources in zip(*(pdf[c] for c in ("mix_id", "lo", "hi", "n", "first", "sources"))):
                for shard, _, many, before in leaves((lo, hi, np.array(n, dtype=np.int64), np.array(first, dtype=np.int64)), seed + mix):
                    some = np.flatnonzero(many)
                    ranks = [np.arange(before[j] + 1, before[j] + many[j] + 1) for j in some]
                    if ranks:
                        yield pd.DataFrame({"mix_id": mix, "source": np.repeat([sources[j] for j in some], many[some]), "rank": np.concatenate(ranks), "shard": shard})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(width, "mix_id", "lo").mapInPandas(below, "mix_id long, source string, rank long, shard long")


def mixed(documents: DataFrame, mix_targets: DataFrame, seed: int = 20150104, shard_tokens: int = SHARD_TOKENS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(mix_id, shard, position, doc_id, source, repeat_no, n_tokens): the selection, shuffled within its shards."""
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "mix_id long, shard long, position long, doc_id long, source string, repeat_no long, n_tokens long")
    rows = mix_targets.where("source is not null and mix_id is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("reps")).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("mix_targets is a small fixed table")
    listed = sorted({r["source"] for r in rows})
    if not listed:
        return empty
    tokens = cut(token_counts(documents.where(F.col("source").isin(listed)), extra=("source",)).where("n_tokens > 0"), "tokens")
    sizes = {r["source"]: (r["n"], r["t"]) for r in tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    takes = []
    for mix in sorted({r["mix_id"] for r in rows}):
        want = quotas(sorted((r["source"], r["share"], r["reps"]) for r in rows if r["mix_id"] == mix), {s: t for s, (_, t) in sizes.items()})
        for s, quota in want.items():
            total = sizes[s][1]
            passes, left = int(quota // total), quota % total
            if total - left < 1e-6 * total:
                passes, left = passes + 1, 0.0
            takes.append((mix, s, passes, int(round(left)), quota))
    if not takes:
        return empty
    many = F.create_map(*[x for s, (n, _) in sizes.items() for x in (F.lit(s), F.lit(max(MIN_BLOCKS, n // block_docs)))])[F.col("source")]
    blocked = tokens.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), many).cast("long"))
    wanted = spark.createDataFrame([x[:4] for x in takes], "mix_id long, source string, passes long, left long")
    per = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(wanted), "source")
    ordered = running(per.withColumn("h", F.xxhash64("mix_id", "source", "block", F.lit(seed))), ["mix_id", "source"], ["h", "block"], "t", "upto")
    rest = F.col("left") - (F.col("upto") - F.col("t"))
    one = lambda no, take: F.struct(no.cast("long").alias("repeat_no"), take.cast("long").alias("take"))
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("passes", F.lit(1))), lambda r: one(r, F.lit(None))))
    last = F.when(rest > 0, F.array(one(F.col("passes") + 1, F.when(rest < F.col("t"), rest))))
    none = F.array().cast("array<struct<repeat_no:bigint,take:bigint>>")
    drawn = ordered.select("mix_id", "source", "block", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(last, none))).alias("d")).select("mix_id", "source", "block", "d.*")
    ranked = running(drawn.withColumns({"h": F.xxhash64("block", "repeat_no", "mix_id", F.lit(seed + 1)), "one": F.lit(1).cast("long")}), ["mix_id", "source"], ["h", "block", "repeat_no"], "one", "rank").drop("h", "one")
    counts: dict[int, dict[str, int]] = {}
    for r in drawn.groupBy("mix_id", "source").count().collect():
        counts.setdefault(r["mix_id"], {})[r["source"]] = r["count"]
    shards = {m: max(1, int(sum(x[4] for x in takes if x[0] == m) // shard_tokens)) for m in counts}
    placed = ranked.join(dealt_blocks(spark, counts, shards, seed), ["mix_id", "source", "rank"]).drop("rank")
    chosen = blocked.join(placed, ["source", "block"])
    order = F.xxhash64("doc_id", "mix_id", "repeat_no", F.lit(seed))
    upto = Window.partitionBy("mix_id", "source", "block", "repeat_no").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = chosen.where("take is not null").withColumn("upto", F.sum("n_tokens").over(upto)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("take")).drop("upto")
    place = F.row_number().over(Window.partitionBy("mix_id", "shard").orderBy(order, "doc_id", "repeat_no")).cast("long")
    return chosen.where("take is null").unionByName(part).select("mix_id", "shard", place.alias("position"), "doc_id", "source", "repeat_no", "n_tokens")


def shares(selection: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per mix and listed source: target and actual share of the tokens, documents drawn, most uses of one document."""
    used = selection.groupBy("mix_id", "source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("t"))
    per = used.groupBy("mix_id", "source").agg(F.sum("t").alias("n_tokens"), F.sum("uses").alias("n_drawn"), F.max("uses").alias("most_uses"))
    total = per.groupBy("mix_id").agg(F.sum("n_tokens").alias("total"))
    listed = mix_targets.select("mix_id", "source", "target_share", "max_repeats")
    joined = listed.join(per, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    return joined.select("mix_id", "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_drawn", "most_uses")], F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
