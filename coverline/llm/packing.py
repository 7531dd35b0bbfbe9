"""Items of varying length into containers of fixed capacity: sum-of-squares online packing.

A container is a level: the tokens it holds. Only the number of open containers of each level matters, kept in a level
array; an item of size s goes to the level l that makes the sum of squares of these numbers least, that is, where
N[l+s] - N[l] is least (a new container is level 0, a full one leaves the array). Documents longer than a container
are cut into full containers and one rest, all others stay whole.

Documents are spread over shards by hash, ``SHARD`` of them on average, and each shard places its own one after another in
the order of a second hash, as they would arrive. The containers that a shard leaves less than ``WELL_FILLED``
full are opened again and their documents placed in a second round, in shards of the same size over the documents left
of all shards, so that the loss of sharding does not add up. Only (doc, tokens) pairs are shuffled, never texts.

Defined results: documents without tokens (null or empty text) are in no container; a document of exactly the capacity
fills one; repeated documents are items of their own; an empty table gives no containers; a non-positive or null
capacity is ignored; container ids are unique within a pack.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverline.llm.tokens import token_counts
from coverline.session import cut

#: Documents a shard holds on average.
SHARD = 20_000
#: Containers filled below this share are packed again in the second round.
WELL_FILLED = 0.98

SCHEMA = "pack_id long, shard long, container long, doc_id long, piece_no long, n_tokens long, capacity long, arrival long"


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item (all at most the capacity), by the sum-of-squares rule in the order given."""
    levels = np.zeros(capacity + 1, dtype=np.int64)
    active = np.zeros(capacity, dtype=bool)  # levels that have an open container
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s >= capacity:
            out[i] = made
            made += 1
            continue
        # gain of moving a container from level l to l + s: 2 * (N[l+s] - N[l]) + 2; a full container counts nothing and is taken on ties
        at = np.flatnonzero(active[: capacity + 1 - s])
        gain = np.where(at + s == capacity, -1, levels[at + s]) - levels[at] if len(at) else at
        best = int(gain.argmin()) if len(at) else -1
        if best < 0 or gain[best] > levels[s] + 1:
            c, level = made, s
            made += 1
        else:
            old = int(at[best])
            c, level = open_at[old].pop(), old + s
            levels[old] -= 1
            active[old] = levels[old] > 0
        if level < capacity:
            levels[level] += 1
            active[level] = True
            open_at[level].append(c)
        out[i] = c
    return out


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    cap = int(pdf["capacity"].iat[0])
    pdf = pdf.sort_values(["arrival", "doc_id", "piece_no"], kind="stable")
    pdf["container"] = pack(pdf["n_tokens"].to_numpy(), cap)
    return pdf[["pack_id", "shard", "container", "doc_id", "piece_no", "n_tokens", "capacity", "arrival"]]


def pieces(tokens: DataFrame, packs: list[tuple[int, int]]) -> DataFrame:
    """One row per pack and piece of a document: whole documents, or full containers and a rest of longer ones."""
    options = F.array(*[F.struct(F.lit(p).cast("long").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in packs])
    each = tokens.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(options).alias("p")).select("doc_id", "n_tokens", "p.*")
    n = F.ceil(F.col("n_tokens") / F.col("capacity"))
    cutp = each.select("doc_id", "pack_id", "capacity", F.col("n_tokens").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece_no"))
    return cutp.select("pack_id", "capacity", "doc_id", "piece_no", F.least(F.col("capacity"), F.col("total") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))


def containers(documents: DataFrame, pack_sizes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(pack_id, capacity, container_id, doc_id, piece_no, n_tokens): which container holds which document or piece."""
    spark = documents.sparkSession
    rows = pack_sizes.where("capacity_tokens > 0 and pack_id is not null").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_sizes is a small fixed table")
    packs = sorted({(r["pack_id"], r["capacity_tokens"]) for r in rows})
    if not packs:
        return spark.createDataFrame([], "pack_id long, capacity long, container_id string, doc_id long, piece_no long, n_tokens long")
    tokens = cut(token_counts(documents), "tokens")
    shards = max(1, -(-tokens.count() // shard))
    items = pieces(tokens, packs)
    whole = items.where("n_tokens = capacity").select("pack_id", "capacity", F.concat_ws("-", F.lit("w"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", "n_tokens")
    rest = items.where("n_tokens < capacity").withColumns({"shard": F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long"), "arrival": F.xxhash64(F.lit("arrival"), "doc_id")})
    first = cut(rest.groupBy("pack_id", "shard").applyInPandas(_pack_shard, SCHEMA), "packed")
    fill = first.groupBy("pack_id", "shard", "container").agg((F.sum("n_tokens") >= F.first("capacity") * WELL_FILLED).alias("good"))
    marked = cut(first.join(fill, ["pack_id", "shard", "container"]), "marked")
    left = marked.where("not good").drop("good", "container")
    again = max(1, -(-(left.groupBy("pack_id").count().agg(F.max("count")).first()[0] or 0) // shard))
    second = left.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(again)).cast("long") + F.lit(shards)).groupBy("pack_id", "shard").applyInPandas(_pack_shard, SCHEMA)
    packed = marked.where("good").select(*second.columns).unionByName(second)
    return whole.unionByName(packed.select("pack_id", "capacity", F.concat_ws("-", "shard", "container").alias("container_id"), "doc_id", "piece_no", "n_tokens"))


def fills(assigned: DataFrame) -> DataFrame:
    """Per pack: containers, items, tokens, share of the space used, least containers possible."""
    per = assigned.groupBy("pack_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return per.groupBy("pack_id", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill"), F.ceil(F.sum("used") / F.first("capacity")).alias("least_containers"),
    )
