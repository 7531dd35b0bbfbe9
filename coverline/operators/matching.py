"""Benefits of two products matched one to one within a canonical key.

Within a key each of our benefits, in order, takes the unused benefit of the other side whose amount text is most
similar (ties: the earlier). Amounts made of the same characters are most similar, so as long as no such class of
amounts of a key has run out, the nth benefit of a class takes the nth of the same class, which is a join on (key, class,
number). Only from the first benefit on that finds its class used up (``late``) one choice depends on another; these are folded
in order by queues of the classes that are left, of which there are few. Blank names share the key "" and match each other.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverline.functions.text import text
from coverline.operators.ranges import running
from coverline.session import cut

PAIR = "key string, our_ord long, comp_ord long"


def classed(side: DataFrame) -> DataFrame:
    """A2: (key, ord, class, nth): the characters of the amount, and the place among those of the key that are made of them."""
    characters = F.array_join(F.array_sort(F.array_distinct(F.split(text("amount"), ""))), "")
    rows = side.select("key", F.col("ord").cast("long").alias("ord"), characters.alias("class"), F.lit(1).cast("long").alias("one"))
    return running(rows, ["key", "class"], ["ord"], "one", "nth").drop("one")


def _likeness(a: str, b: str) -> float:
    return len(set(a) & set(b)) / max(len(a), len(b)) if a and b else float(a == b)


def _fold(ours: pd.DataFrame, comps: pd.DataFrame) -> pd.DataFrame:
    """Late benefits of a key in order, each with the most similar one that is left."""
    queues: dict[str, deque] = {}
    for c, o in comps.sort_values("ord")[["class", "ord"]].itertuples(index=False):
        queues.setdefault(c, deque()).append(o)
    out, likeness = [], {}
    for c, o in ours.sort_values("ord")[["class", "ord"]].itertuples(index=False):
        if c in queues:
            best = c
        else:
            score = lambda x: likeness.setdefault((c, x), _likeness(c, x))
            best = min(queues, key=lambda x: (-score(x), queues[x][0]), default=None)
        if best is None:
            out.append((o, None))
            continue
        out.append((o, queues[best].popleft()))
        if not queues[best]:
            del queues[best]
    out += [(None, o) for q in queues.values() for o in q]
    key = (ours if len(ours) else comps)["key"].iat[0]
    return pd.DataFrame({"key": key, "our_ord": pd.array([a for a, _ in out], dtype="Int64"), "comp_ord": pd.array([b for _, b in out], dtype="Int64")})


def paired(our: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, our_ord, comp_ord, match_type) from two sides of (ord, key, amount)."""
    comps = cut(classed(comp), "comps")
    there = comps.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m"))
    ours = classed(our).join(there, ["key", "class"], "left").withColumn("lacks", F.col("nth") > F.coalesce("m", F.lit(0)))
    ours = cut(ours, "ours")
    late_from = ours.where("lacks").groupBy("key").agg(F.min("ord").alias("from"))
    ours = ours.join(late_from, "key", "left").withColumn("late", F.coalesce(F.col("ord") >= F.col("from"), F.lit(False)))
    early = ours.where("not late").select("key", "class", "nth", F.col("ord").alias("our_ord")).join(comps.withColumnRenamed("ord", "comp_ord"), ["key", "class", "nth"])
    early = cut(early.select("key", "our_ord", "comp_ord"), "early")
    left = comps.join(early.select(F.col("comp_ord").alias("ord")), "ord", "left_anti")
    waiting = ours.where("late").select("key", "ord", "class")
    alone = left.join(late_from, "key", "left_anti").select("key", F.lit(None).cast("long").alias("our_ord"), F.col("ord").alias("comp_ord"))
    contested = left.join(late_from, "key", "left_semi").select("key", "ord", "class")
    # a key that has nothing left on the other side needs no fold
    nothing = waiting.join(contested.select("key").distinct(), "key", "left_anti").select("key", F.col("ord").alias("our_ord"), F.lit(None).cast("long").alias("comp_ord"))
    some = waiting.join(contested.select("key").distinct(), "key", "left_semi")
    folded = some.groupBy("key").cogroup(contested.groupBy("key")).applyInPandas(_fold, PAIR)
    kind = F.when(F.col("our_ord").isNull(), "comp_only").when(F.col("comp_ord").isNull(), "our_only").otherwise("matched")
    return early.unionByName(alone).unionByName(nothing).unionByName(folded).select("key", "our_ord", "comp_ord", kind.alias("match_type"))


def counts_by_key(our: DataFrame, comp: DataFrame) -> DataFrame:
    """A3 by key, without pairing: matched, our_only and comp_only follow from the numbers on both sides."""
    n = our.select("key", F.lit(1).alias("o"), F.lit(0).alias("c")).unionByName(comp.select("key", F.lit(0).alias("o"), F.lit(1).alias("c"))).groupBy("key").agg(F.sum("o").alias("o"), F.sum("c").alias("c"))
    return n.select("key", F.least("o", "c").alias("matched"), F.greatest(F.col("o") - F.col("c"), F.lit(0)).alias("our_only"), F.greatest(F.col("c") - F.col("o"), F.lit(0)).alias("comp_only"))


def match_counters(our: DataFrame, comp: DataFrame) -> DataFrame:
    """A3: one row of the three counters."""
    return counts_by_key(our, comp).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("matched", "our_only", "comp_only")])
