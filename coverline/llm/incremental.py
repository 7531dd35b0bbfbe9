"""New batches against all accepted history, without going through the history again.

The history is two tables in directories by bucket of the exact part. ``parts`` holds the first record of every
exact part (product, contract, meaning of the benefit, worth of the amount, condition, all numbers of the trigger) as a
128-bit hash with a 64-bit check and the minwise signature of its trigger; ``variants`` holds every other signature accepted
under a part with its record and its place in the order of arrival. A batch probes the parts in its own buckets and is verified by
signature. What hits a part without being similar to its first record meets the signatures of that part that came before it,
of the history and of the batch itself, and belongs to the record of the earliest one it is similar to. Then what is new is
appended. The read of a batch is pruned to the buckets its parts fall into, and no past row or text is read.

Everything is decided within a part and by what arrived before (batch by batch, within one by id). Batches that are there together
are therefore accepted together, in a constant number of steps, with the answer of one after another. A part's
signatures are compared only where they share one of ``PAIRS``, which by the pigeonhole principle loses no similar pair.

TESTDATA.md defines a record by equal numbers and cause "apart from ... small changes of wording", which five-word
shingles at 0.8 can't follow in texts of a dozen words; signatures are therefore taken over pairs of syllables, and
``SIMILAR`` agreeing values of ``BINS`` verify (within equal exact parts, other causes lie far below).

Defined results: null and "" are the same value; rows without id or of an unknown artifact belong to no batch and are left out;
blank file hashes never count; equal signatures of a part are one variant, and only rows of a later batch than the
record's lowest row are reported; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverline.llm.confusables import one_form
from coverline.llm.mapping import benefit_targets
from coverline.operators.units import unit_hint, won
from coverline.session import bounded, cut, scratch_path

#: Values of a signature, of eight bits each.
BINS = 16
#: Agreeing values of BINS that verify; two unrelated signatures agree in none or one, those of a reworded trigger in eight or more.
SIMILAR = 4

_DIGIT_RUN = re.compile(r"[0-9OILBSZQ]*\d[0-9OILBSZQ]*")
_MISREAD = str.maketrans("OQILBSZ", "0011852")
_ODD = re.compile(r"[^\x00-\x7f가-힣·]")
_OTHER = re.compile(r"[^가-힣]+")


#: A line that holds nothing but a page number: a number, marks and at most one short word on either side.
_PAGE = re.compile(r"\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|[〔\[(<]\s*\d{1,4}\s*[〕\])>]|(?:[^\W\d]{1,4}\.?\s*)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?(?:쪽|면|\s*페이지)?)\s*")
_NOT_LETTERS = re.compile(r"\W+")


def without_furniture(text: str, names: tuple[str | None, ...]) -> str:
    """The text without inner lines that hold nothing but a page number or that name the record's own insurer or product, as running headers do."""
    lines = text.split("\n")
    own = [n for n in (_NOT_LETTERS.sub("", x) for x in names if x) if n]
    furniture = lambda x: _PAGE.fullmatch(x) is not None or any(n in (t := _NOT_LETTERS.sub("", x)) for n in own)
    return "\n".join(x for i, x in enumerate(lines) if i == 0 or not furniture(x))


def trigger_parts(text: str | None, names: tuple[str | None, ...] = ()) -> tuple[str, str]:
    """(numbers in order, syllables) of a trigger without headers and page numbers; misread digits are read as digits."""
    if not text:
        return "", ""
    if "\n" in text:
        text = without_furniture(text, names)
    t = (one_form(text) if _ODD.search(text) else text).upper()
    return " ".join(_DIGIT_RUN.findall(t)).translate(_MISREAD), _OTHER.sub("", t)


def signatures(texts: list[str]) -> np.ndarray:
    """One-permutation minwise signatures over syllable pairs: BINS values of eight bits in two longs, empty bins filled from the next full one."""
    n = len(texts)
    sig = np.full((n, BINS), 0xFFFFFFFF, dtype=np.uint32)
    joined = "\u0000".join(texts) + "\u0000"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    owner = np.cumsum(codes == 0) - (codes == 0)
    a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    ok = (a != 0) & (b != 0)
    h = (a[ok] * np.uint64(0x10001) + b[ok]) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    slot = owner[:-1][ok] * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
    np.minimum.at(sig.reshape(-1), slot, ((h >> np.uint64(8)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    for _ in range(BINS):
        empty = sig == 0xFFFFFFFF
        if not empty.any():
            break
        sig = np.where(empty, np.roll(sig, -1, axis=1), sig)
    return (sig >> np.uint32(12)).astype(np.uint8).view(np.int64)


def _trigger_features(text: pd.Series, insurer: pd.Series, product: pd.Series) -> pd.DataFrame:
    """Numbers and signature of every trigger of a batch; repeated triggers of one line are computed once."""
    several = text.fillna("").str.contains("\n", regex=False)
    codes, distinct = pd.factorize(text.fillna("").where(~several, text.fillna("") + "\u0001" + insurer.fillna("") + "\u0001" + product.fillna("")))
    parts = [trigger_parts(x, tuple(more)) for x, *more in (d.split("\u0001") for d in distinct)]
    sig = signatures([p[1] for p in parts])
    numbers = np.array([p[0] for p in parts] or [""], dtype=object)
    return pd.DataFrame({"numbers": numbers[codes], "sa": sig[codes, 0], "sb": sig[codes, 1]})


trigger_features = F.pandas_udf(_trigger_features, T.StructType([T.StructField("numbers", T.StringType()), T.StructField("sa", T.LongType()), T.StructField("sb", T.LongType())])).asNondeterministic()


def plain(text: Column) -> Column:
    """A value without white space, case and punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\p{P}\p{Cf}\p{Mn}]+", ""))


def row_features(rows: DataFrame, artifacts: DataFrame, synonyms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(row_id, batch_no, part, check, sa, sb): the exact part of the record as a 128-bit hash with a 64-bit check, and its trigger's signature."""
    hint = unit_hint(F.col("notes_summary"), F.col("amount"))
    insurer = F.col("insurer") if "insurer" in rows.columns else F.lit(None).cast("string")
    read = rows.where("row_id is not null").select(
        "row_id", "artifact_id", "benefit_name", plain(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in ("product_name", "contract_name", "amount_condition")])).alias("exact"),
        plain(F.col("amount")).alias("amount"), won("amount", hint).alias("won"), trigger_features(F.replace(F.col("trigger"), F.lit("\u0001"), F.lit(" ")), insurer, "product_name").alias("t"),
    )
    worth = F.coalesce(F.col("won").cast("string"), F.col("amount"))
    whole = F.concat_ws("\u0001", "exact", worth, "t.numbers")
    # only hashes go through the joins
    narrow = read.select("row_id", "artifact_id", "benefit_name", F.unhex(F.md5(whole)).alias("part"), F.xxhash64(whole).alias("check"), "t.sa", "t.sb")
    batches = artifacts.where("batch_no is not null and artifact_id is not null").select("artifact_id", "batch_no")
    targets = benefit_targets(rows, synonyms, catalog).where("target_id >= 0").withColumnRenamed("name", "benefit_name")
    meant = narrow.join(bounded(batches), "artifact_id").join(targets, "benefit_name", "left")
    benefit = F.coalesce(F.col("target_id").cast("string"), plain(F.col("benefit_name")))
    return meant.select("row_id", "batch_no", F.unhex(F.md5(F.concat("part", F.encode(benefit, "UTF-8")))).alias("part"), F.xxhash64("check", benefit).alias("check"), "sa", "sb")


def agreement(a: tuple[str, str] = ("sa", "sb"), b: tuple[str, str] = ("ra", "rb")) -> Column:
    """Number of agreeing minwise values of two signatures."""

    def differing(x: Column) -> Column:
        for n in (4, 2, 1):  # the eight bits of a value brought together in its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(BINS) - differing(F.col(a[0]).bitwiseXOR(F.col(b[0]))) - differing(F.col(a[1]).bitwiseXOR(F.col(b[1])))


#: Pairs of values of which two signatures that agree in SIMILAR values share one at least: of SIMILAR - 1 groups of places, two of these lie in one.
PAIRS = [p for places in np.array_split(np.arange(BINS), SIMILAR - 1) for p in combinations(places.tolist(), 2)]

VARIANT = ["part", "check", "sa", "sb"]


def earliest_alike(group: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For rows in order of arrival: the first row before each of ``asked`` in its group that agrees in SIMILAR values; the row itself if there is none."""
    best = np.arange(len(values))
    for j, k in PAIRS:
        key = (group.astype(np.int64) << 16) | (values[:, j].astype(np.int64) << 8) | values[:, k]
        order = np.argsort(key, kind="stable")
        rows, at = asked, np.searchsorted(key[order], key[asked])
        while len(rows):  # the rows of equal key one after another, as far as the earliest found so far
            other = order[at]
            before = other < best[rows]
            rows, at, other = rows[before], at[before], other[before]
            alike = (values[rows] == values[other]).sum(axis=1) >= SIMILAR
            best[rows[alike]] = other[alike]
            rows, at = rows[~alike], at[~alike] + 1
    return best[asked]


def _linked(members: pd.DataFrame) -> pd.DataFrame:
    """Open signatures with the record of the earliest signature they are like, which may be open itself; else their own."""
    members = members.sort_values(["part", "check", "run", "batch_no", "rid"], ignore_index=True)
    group = ((members["part"] != members["part"].shift()) | (members["check"] != members["check"].shift())).cumsum().to_numpy()
    values = np.ascontiguousarray(members[["sa", "sb"]].to_numpy(dtype=np.int64)).view(np.uint8)
    lead, asked = np.arange(len(members)), np.flatnonzero(members["open"].to_numpy())
    lead[asked] = earliest_alike(group, values, asked)
    while ((up := lead[lead]) != lead).any():
        lead = up
    members["record"] = members["record"].to_numpy()[lead]
    return members.loc[asked, [*VARIANT, "record"]]


class History:
    """Persisted signatures of everything accepted so far, below a folder all executors share."""

    SCHEMA = {
        "parts": "part binary, check long, record long, ra long, rb long, run int, bucket int",
        "variants": "part binary, check long, sa long, sb long, record long, batch_no long, rid long, run int, bucket int",
    }

    def __init__(self, spark, path: str | None = None, runs: int = 0, kinds: tuple[str, ...] = (), buckets: int | None = None):
        """``buckets`` must stay the same for as long as a history is kept; by default one for every shuffle partition of the session. ``runs`` and ``kinds`` say what is there already."""
        self.spark, self.path, self.kinds, self.runs = spark, path or scratch_path(spark, "history"), set(kinds), runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucket(self) -> Column:
        """Bucket of a part: by the hash that also deals it to a shuffle partition, so that a bucket is written by one task."""
        return F.pmod(F.hash("part", "check"), F.lit(self.buckets)).cast("int")

    def keys(self, kind: str, hit: list[int]) -> DataFrame:
        """The signatures in the buckets that are hit; other directories are not read."""
        if kind not in self.kinds or not hit:
            return self.spark.createDataFrame([], self.SCHEMA[kind])
        found = self.spark.read.schema(self.SCHEMA[kind]).parquet(f"{self.path}/{kind}")
        return found.where(F.col("bucket").isin(hit)) if len(hit) < self.buckets else found

    def append(self, kind: str, keys: DataFrame) -> None:
        keys.withColumns({"run": F.lit(self.runs), "bucket": self.bucket()}).write.mode("append").partitionBy("run", "bucket").parquet(f"{self.path}/{kind}")
        self.kinds.add(kind)

    def accept(self, rows: DataFrame, hit: list[int] | None = None) -> DataFrame:
        """(batch_no, rid, record) of the rows (part, check, sa, sb, rid) of a batch: probe, verify, append what is new.

        Several batches at once have a ``batch_no``; they get the answer of one after another."""
        if "batch_no" not in rows.columns:
            rows = rows.withColumn("batch_no", F.lit(0).cast("long"))
        if hit is None:
            hit = [r[0] for r in rows.select(self.bucket()).distinct().collect()] if self.kinds else list(range(self.buckets))
        leaders = rows.groupBy("part", "check").agg(F.min(F.struct("batch_no", "rid", "sa", "sb")).alias("f")).select("part", "check", F.col("f.rid").alias("record"), F.col("f.sa").alias("ra"), F.col("f.sb").alias("rb"))
        if self.kinds:
            leaders = leaders.join(self.keys("parts", hit).select("part", "check"), ["part", "check"], "left_anti")
        self.append("parts", leaders)
        met = rows.select(*VARIANT, "batch_no", "rid").join(self.keys("parts", hit).select("part", "check", "record", "ra", "rb"), ["part", "check"])
        first, same = (F.col("sa") == F.col("ra")) & (F.col("sb") == F.col("rb")), agreement() >= SIMILAR
        # of what equals its first record nothing is kept but the link
        met = cut(met.select(*[F.when(~first, F.col(c)).alias(c) for c in VARIANT], "batch_no", "rid", F.when(same, F.col("record")).alias("record")), "met")
        done, known = met.where("record is not null").select("batch_no", "rid", "record"), None
        unlike = met.where("part is not null").groupBy(*VARIANT, "record").agg(F.min(F.struct("batch_no", "rid")).alias("f")).select(*VARIANT, "record", "f.*")
        flags = met.agg(F.count("part"), F.count(F.when(F.col("record").isNull(), 1))).first()
        if "variants" in self.kinds:
            known = self.keys("variants", hit).select(*VARIANT, "record", "batch_no", "rid", "run")
        if flags[1]:
            linked = cut(self.linked(unlike, known), "linked")
            done = done.unionByName(met.where("record is null").select(*VARIANT, "batch_no", "rid").join(linked, VARIANT).select("batch_no", "rid", "record"))
            unlike = unlike.where("record is not null").unionByName(unlike.where("record is null").drop("record").join(linked, VARIANT))
        if flags[0]:
            new = unlike if known is None else unlike.join(known.select(VARIANT), VARIANT, "left_anti")
            self.append("variants", new.repartition("part", "check").select(*VARIANT, "record", "batch_no", "rid"))
        self.runs += 1
        return done

    def linked(self, unlike: DataFrame, known: DataFrame | None) -> DataFrame:
        """(part, check, sa, sb, record) of the signatures unlike the first record of their part, by all signatures of those parts."""
        members = unlike.withColumn("run", F.lit(self.runs))
        members = members if known is None else members.unionByName(known)
        crowded = unlike.where("record is null").select("part", "check").distinct()
        members = members.join(crowded, ["part", "check"], "left_semi").select(*VARIANT, "run", "batch_no", "rid", F.coalesce("record", "rid").alias("record"), F.col("record").isNull().alias("open"), self.bucket().alias("bucket"))
        return members.groupBy("bucket").applyInPandas(_linked, "part binary, check long, sa long, sb long, record long")


def artifacts_found(artifacts: DataFrame) -> DataFrame:
    """(id_a, id_b): artifacts that carry the same file as the first artifact that has it, from an earlier batch."""
    h = F.regexp_replace(F.lower(F.coalesce("file_hash", F.lit(""))), r"^\s*(?:sha-?\d+|md5)\s*[:=]|[^0-9a-z]", "")
    hashed = artifacts.where("batch_no is not null").select("artifact_id", "batch_no", h.alias("h")).where("h <> ''")
    first = hashed.groupBy("h").agg(F.min(F.struct("batch_no", "artifact_id")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = hashed.join(first, "h").where("batch_no > f.batch_no")
    return pairs.select(F.least("f.artifact_id", "artifact_id").alias("id_a"), F.greatest("f.artifact_id", "artifact_id").alias("id_b"))


def repeats_found(rows: DataFrame, artifacts: DataFrame, synonyms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): artifacts and rows of later batches that repeat something accepted before."""
    features = cut(row_features(rows, artifacts, synonyms, catalog), "features").withColumnRenamed("row_id", "rid")
    assigned = History(rows.sparkSession).accept(features)
    lowest = assigned.groupBy("record").agg(F.min(F.struct("rid", "batch_no")).alias("a"), F.max("batch_no").alias("last")).where("last > a.batch_no")
    by_row = assigned.join(lowest, "record").where("batch_no > a.batch_no").select(F.lit("row").alias("kind"), F.col("a.rid").alias("id_a"), F.col("rid").alias("id_b"))
    return artifacts_found(artifacts).select(F.lit("artifact").alias("kind"), "id_a", "id_b").unionByName(by_row)
