"""Free-entered values to the entries of a canonical list, in built-in expressions and joins only.

The reference list holds every spelling of every entry: for benefit names the compositions of a disease (or procedure)
variant and a kind-of-benefit variant in either order, for lexicon variants the variants of each slot. References
and values are brought to one key (look-alikes, case, marks, filler words) and to a sequence of basic letters: Hangul
syllables are taken apart into the letters they are typed with, so that one slip of the finger is one edit, and text
typed on the wrong keyboard layout is the same sequence again.

A value is answered by the pigeonhole join: a reference is cut into k+1 positional segments, of which one is intact in
every value within k edits; segments and the substrings of a value they may equal are joined on (length, k, number,
segment), and ``levenshtein`` verifies. It runs twice: with k = 0 (one segment, the whole reference) for the value as
written, and for what is left both with k = 0 for the value with one syllable repeated or two exchanged (which comes first) and
with ``budget`` edits, one for every ``LETTERS_PER_EDIT`` letters of the reference and two at most. What stays unanswered is reported through an anti-join.

Words the lexicon lacks (foreign names, Chinese characters, new coinages) can't be found by spelling. They are learned from
the rows at hand: where a name that found no reference consists of a known word of one slot and an unknown one, the
triggers of all rows with that unknown word are read for words that occur with one label of its slot only (``INDICATES``,
counted over a bounded sample of ``SAMPLE`` answered rows). An unknown word whose triggers (``LEAST`` different ones) point
to one label, and to no other as often, joins the lexicon under it, and the names are matched again; a name itself is then judged by itself alone.

Only distinct values go through the steps, spread over all shuffle partitions (few bytes, much work); the reference
list is fixed and size-checked before it is broadcast. Rows get their answer by a join on the value, whose hot values AQE
splits.

Defined results: null, empty and blank names are no cases; a value literally equal to a canonical name is no case;
names whose disease and kind are known but not in the catalogue together give -1; equally near references give the
one of least distance, then least id; repeated values get one answer each row; very long values simply match nothing;
a word with fewer triggers than ``LEAST`` stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.llm.confusables import latin_translate
from coverline.session import bounded, cut

#: One edit is allowed for so many letters of a reference, two at most.
LETTERS_PER_EDIT, MOST_EDITS = 4, 2
#: Answered rows the words of triggers are weighed on (a bounded sample of labelled rows).
SAMPLE = 20_000
#: Share of a trigger word's rows that must carry one label, and the rows it takes, for the word to indicate the label.
INDICATES, SEEN = 0.9, 5
#: Different triggers an unknown word needs, and the share of them that must indicate its label.
LEAST, AGREES = 4, 0.7

# Words around a name that do not change what it means.
PREFIX_WORDS = r"^(?:\(?신\)|\(무\)|신규\s)"
SUFFIX_WORDS = r"(?:\s*(?:\(특약\)|\[특약\]|보장특약|특약|담보|지급|등|\(?\s*[1-9]회한\s*\)?|\[\s*[1-9]회한\s*\]|보장|급부))+$"
INNER_WORDS = r"(?<=\S)(?:[\s\p{P}]*에[\s\p{P}]*대한|[\s\p{P}]*관련|(?:의|시)(?=[\s/·,:_\-\[(]))"

# The letters of the two-set keyboard; compounds are typed as two letters.
_LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_VOWELS = ["ㅏ", "ㅐ", "ㅑ", "ㅒ", "ㅓ", "ㅔ", "ㅕ", "ㅖ", "ㅗ", "ㅗㅏ", "ㅗㅐ", "ㅗㅣ", "ㅛ", "ㅜ", "ㅜㅓ", "ㅜㅔ", "ㅜㅣ", "ㅠ", "ㅡ", "ㅡㅣ", "ㅣ"]
_TAILS = ["", "ㄱ", "ㄲ", "ㄱㅅ", "ㄴ", "ㄴㅈ", "ㄴㅎ", "ㄷ", "ㄹ", "ㄹㄱ", "ㄹㅁ", "ㄹㅂ", "ㄹㅅ", "ㄹㅌ", "ㄹㅍ", "ㄹㅎ", "ㅁ", "ㅂ", "ㅂㅅ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]
_KEYS_FROM = "rRseEfaqQtTdwWczxvgkoiOjpuPhynbml" + "SFADCZXVGKIJUHYNBML"
_KEYS_TO = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎㅏㅐㅑㅒㅓㅔㅕㅖㅗㅛㅜㅠㅡㅣ" + "ㄴㄹㅁㅇㅊㅋㅌㅍㅎㅏㅑㅓㅕㅗㅛㅜㅠㅡㅣ"


def letters(text: Column) -> Column:
    """Hangul syllables taken apart into the letters they are typed with; every other character counts as two, as it stands for a syllable or a good part of it."""
    vowels, tails = "".join(f"{v:<2}" for v in _VOWELS), "".join(f"{t:<2}" for t in _TAILS)

    def one(c: Column) -> Column:
        code = F.ascii(c) - 0xAC00
        parts = F.concat(
            F.substring(F.lit(_LEADS), F.floor(code / 588).cast("int") + 1, F.lit(1)),
            F.substring(F.lit(vowels), (F.floor((code % 588) / 28) * 2).cast("int") + 1, F.lit(2)),
            F.substring(F.lit(tails), (code % 28) * 2 + 1, F.lit(2)),
        )
        lead = F.substring(F.lit(_LEADS), F.ascii(c) - 0x1100 + 1, F.lit(1))
        vowel = F.substring(F.lit(vowels), (F.ascii(c) - 0x1161) * 2 + 1, F.lit(2))
        tail = F.substring(F.lit(tails), (F.ascii(c) - 0x11A7) * 2 + 1, F.lit(2))
        return F.when(c.between("가", "힣"), parts).when(c.between("\u1100", "\u1112"), lead).when(c.between("\u1161", "\u1175"), vowel).when(c.between("\u11a8", "\u11c2"), tail).when(c.between("ㄱ", "ㅣ"), c).otherwise(F.concat(c, c))

    return F.replace(F.array_join(F.transform(F.split(text, ""), one), ""), F.lit(" "), F.lit(""))


def compact(text: Column) -> Column:
    """Letters and digits of a text in lower case, look-alikes and widths folded."""
    return F.lower(F.regexp_replace(latin_translate(text), r"[^\p{L}\p{N}]+|[ᆞㆍ]", ""))


def without_fillers(text: Column) -> Column:
    """The text without the words that do not change what a name means."""
    t = F.regexp_replace(latin_translate(text), r"[\p{Cf}\p{Mn}]", "")
    t = F.regexp_replace(t, r"(?U)^[\s\p{P}&&[^(]]+|[\s\p{P}&&[^)\]]]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, PREFIX_WORDS, ""), SUFFIX_WORDS, "")
    return F.regexp_replace(t, INNER_WORDS, " ")


def spellings(text: Column) -> Column:
    """The letter sequences a value may stand for: as written, without fillers, and as typed on the other keyboard layout."""
    plain, bare = letters(compact(text)), letters(compact(without_fillers(text)))
    keys = F.regexp_replace(text, r"[^A-Za-z]+", "")
    latin = keys.rlike(".") & ~text.rlike(r"[^\p{ASCII}\p{P}\s]")
    typed = [F.when(latin, F.translate(k, _KEYS_FROM, _KEYS_TO)) for k in (keys, F.lower(keys))]
    linked = letters(F.regexp_replace(compact(without_fillers(text)), "(?<=.)의", ""))
    return F.array_distinct(F.array_compact(F.array(plain, F.when(F.length(bare) > 0, bare), F.when(text.contains("의") & (F.length(bare) > 0), linked), *typed)))


def slips(t: Column) -> Column:
    """Letter sequences of a text with one repeated syllable taken out or two neighbouring syllables exchanged."""
    syllables = F.transform(F.split(t, ""), letters)

    def variants(arr: Column) -> Column:
        n = F.size(arr)
        steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        swap = lambda i: F.concat(F.slice(arr, 1, i - 1), F.slice(arr, i + 1, 1), F.slice(arr, i, 1), F.slice(arr, i + 2, n))
        drop = lambda i: F.when(F.get(arr, i - 1) == F.get(arr, i), F.concat(F.slice(arr, 1, i), F.slice(arr, i + 2, n)))
        return F.transform(F.array_compact(F.concat(F.transform(steps, swap), F.transform(steps, drop))), lambda x: F.array_join(x, ""))

    return F.array_distinct(F.flatten(F.transform(F.array(syllables), variants)))


def budget(n: Column) -> Column:
    """Edits allowed for a reference of ``n`` letters."""
    return F.least(F.floor(n / LETTERS_PER_EDIT), F.lit(MOST_EDITS)).cast("int")


def _segments(refs: DataFrame, edits: Column | None = None) -> DataFrame:
    """References cut into k+1 positional segments: (slot, len, k, no, seg, ref, target_id)."""
    n, k = F.length("ref"), F.col("k")
    part = lambda i: F.struct(i.alias("no"), F.substring(F.col("ref"), F.floor(n * i / (k + 1)).cast("int") + 1, (F.floor(n * (i + 1) / (k + 1)) - F.floor(n * i / (k + 1))).cast("int")).alias("seg"))
    keyed = refs.where("ref <> ''").withColumn("k", budget(n) if edits is None else edits)
    return keyed.select("slot", "ref", "target_id", n.alias("len"), "k", F.explode(F.transform(F.sequence(F.lit(0), k), part)).alias("c")).select("slot", "len", "k", "c.no", "c.seg", "ref", "target_id")


def _probes(values: DataFrame, edits: Column | None = None, most: int = MOST_EDITS) -> DataFrame:
    """Substrings of a spelling that a segment of a reference may equal: (slot, len, k, no, seg, key, spelling, slip).

    Where i segments before the intact one hold an edit each, it is shifted by at most i, and so from the other end.
    """
    cells = [(k, d, i, s) for k in range(most + 1) for d in range(-k, k + 1) for i in range(k + 1) for s in range(-i, i + 1) if abs(d + s) <= k - i]
    grid = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip("kdis", cell)]) for cell in cells])
    p = values.select("slot", "key", "spelling", "slip", F.explode(grid).alias("g")).select("slot", "key", "spelling", "slip", "g.k", "g.s", F.col("g.i").alias("no"), (F.length("spelling") + F.col("g.d")).alias("len"))
    p = p.where(F.col("k") == (budget(F.col("len")) if edits is None else edits))
    lo, hi = F.floor(F.col("len") * F.col("no") / (F.col("k") + 1)), F.floor(F.col("len") * (F.col("no") + 1) / (F.col("k") + 1))
    p = p.withColumn("from", (lo + F.col("s")).cast("int") + 1).withColumn("many", (hi - lo).cast("int"))
    return p.where((F.col("from") >= 1) & (F.col("many") > 0) & (F.col("from") + F.col("many") - 1 <= F.length("spelling"))).select("slot", "len", "k", "no", F.expr("substring(spelling, from, many)").alias("seg"), "key", "spelling", "slip")


def nearest(values: DataFrame, refs: DataFrame, edits: Column | None = None, most: int = MOST_EDITS, few: bool = False, slipped: DataFrame | None = None) -> DataFrame:
    """(slot, key, target_id) of (slot, key, spelling, slip) values within the edits of a reference, by the pigeonhole join on k+1 segments.

    ``slipped`` values take part with no edit. ``few`` references have been counted and are broadcast."""
    segments, probes = _segments(refs, edits), _probes(values, edits, most)
    if slipped is not None:
        segments, probes = segments.unionByName(_segments(refs, F.lit(0))).distinct(), probes.unionByName(_probes(slipped, F.lit(0), 0))
    pairs = probes.join(F.broadcast(segments) if few else segments, ["slot", "len", "k", "no", "seg"]).select("slot", "key", "spelling", "slip", "ref", "target_id", "k").distinct()
    near = pairs.select("slot", "key", "slip", "target_id", F.levenshtein("spelling", "ref", most).alias("d"), "k").where("d >= 0 and d <= k")
    return near.groupBy("slot", "key").agg(F.min(F.struct((-F.col("slip")).alias("slip"), "d", (F.col("target_id") < 0).alias("none"), "target_id")).alias("m")).select("slot", "key", F.col("m.target_id").alias("target_id"))


#: References of one list that may be broadcast.
MOST_REFERENCES = 50_000


def match(values: DataFrame, refs: DataFrame) -> DataFrame:
    """(slot, key, target_id) for every distinct (slot, key, text) value that has a reference."""
    refs = cut(refs.groupBy("slot", "ref").agg(F.max("target_id").alias("target_id")), "refs")
    n, longest = refs.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("ref")), F.lit(0))).first()
    few, longest = n <= MOST_REFERENCES, longest + MOST_EDITS  # nothing longer is within the edits of a reference
    width = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)  # few bytes, much work: no coalescing
    text = F.col("text")
    shapes = F.array(compact(text), compact(without_fillers(text)))
    swapped = F.array_distinct(F.flatten(F.transform(F.filter(shapes, lambda t: F.length(t) <= longest + 1), slips)))
    spell = lambda df, forms, slip: df.select("slot", "key", F.explode(forms).alias("spelling"), F.lit(slip).alias("slip")).where((F.length("spelling") > 0) & (F.length("spelling") <= longest))
    spread = cut(values.repartition(width, F.xxhash64("key")), "values")
    spelled = cut(spell(spread, spellings(text), 0), "spelled")
    whole = cut(nearest(spelled, refs, F.lit(0), 0, few), "whole")
    rest = lambda df: df.join(whole, ["slot", "key"], "left_anti").repartition(width, F.xxhash64("key"))
    return cut(whole.unionByName(nearest(rest(spelled), refs, few=few, slipped=spell(rest(spread), swapped, 1))), "matched")


def lexicon(synonyms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(slot, label, variant) of the assigned synonyms and the catalogue's own names."""
    listed = synonyms.where("label is not null and coalesce(variant, '') <> ''").select("slot", "label", "variant")
    own = catalog.where("coalesce(disease, '') <> ''").select(F.lit("disease").alias("slot"), F.col("disease").alias("label"), F.col("disease").alias("variant"))
    words = cut(listed.unionByName(own).distinct(), "lexicon")
    if words.limit(MAX_WORDS + 1).count() > MAX_WORDS:
        raise ValueError(f"a lexicon of composed names holds at most {MAX_WORDS} words")
    return words


def name_references(words: DataFrame, catalog: DataFrame) -> DataFrame:
    """(slot, ref, target_id) of every composition of a disease variant and a kind-of-benefit variant in either order; -1 where the catalogue has no such entry."""
    lex = words.select("slot", "label", compact(F.col("variant")).alias("v")).where("v <> ''")
    entries = catalog.where("disease is not null and action is not null").groupBy("disease", "action").agg(F.min("canonical_id").alias("target_id"))
    # every disease meets every kind of benefit over one constant key; both are lexicon lists, checked for size
    of = lambda slot, name: lex.where(F.col("slot") == slot).select(F.col("label").alias(name), F.col("v").alias(f"{name}_v")).distinct()
    ds, acts = of("disease", "disease"), of("action", "action")
    known = ds.withColumn("one", F.lit(1)).join(F.broadcast(acts.withColumn("one", F.lit(1))), "one").join(F.broadcast(entries), ["disease", "action"], "left")
    orders = F.array(F.concat("disease_v", "action_v"), F.concat("action_v", "disease_v"))
    composed = known.select(F.explode(F.transform(orders, letters)).alias("ref"), F.coalesce("target_id", F.lit(-1)).alias("target_id"))
    whole = catalog.where("canonical_name is not null").select(letters(compact(F.col("canonical_name"))).alias("ref"), F.col("canonical_id").alias("target_id"))
    return composed.unionByName(whole).groupBy("ref").agg(F.max("target_id").alias("target_id")).select(F.lit("name").alias("slot"), "ref", "target_id")


#: Words of a lexicon whose compositions are made.
MAX_WORDS = 2_000


def variant_references(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(slot, ref, target_id) of every variant of every label, by slot."""
    ids = synonyms.where("label is not null").groupBy("slot", "label").agg(F.min("label_id").alias("target_id"))
    return words.join(ids, ["slot", "label"]).select("slot", letters(compact(F.col("variant"))).alias("ref"), "target_id").groupBy("slot", "ref").agg(F.min("target_id").alias("target_id"))


def _trigger_words(trigger: Column) -> Column:
    """Words of a text and pairs of neighbouring words, marks and blanks left out, each once."""
    words = F.filter(F.split(F.lower(trigger), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def learned_words(rows: DataFrame, names: DataFrame, matched: DataFrame, words: DataFrame, catalog: DataFrame) -> DataFrame:
    """(slot, label, variant) of unknown words of names without a reference, by the triggers they stand with in all rows."""
    lex = words.where("slot in ('disease', 'action')").select("slot", "label", compact(F.col("variant")).alias("v")).where("v <> ''").distinct()
    left = names.join(matched.select(F.col("key").alias("name")), "name", "left_anti")
    bare = left.select("name", compact(without_fillers(F.col("name"))).alias("t")).where("length(t) >= 3")
    cuts = bare.select("name", "t", F.explode(F.sequence(F.lit(1), F.length("t") - 1)).alias("i")).select("name", F.expr("substring(t, 1, i)").alias("a"), F.expr("substring(t, i + 1)").alias("b"))
    sides = cuts.select("name", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("word")), F.struct(F.col("b").alias("v"), F.col("a").alias("word")))).alias("s")).select("name", "s.*")
    unknown = sides.join(F.broadcast(lex.select(F.when(F.col("slot") == "disease", "action").otherwise("disease").alias("slot"), "v").distinct()), "v")
    unknown = unknown.groupBy("name", "slot").agg(F.max_by("word", F.struct(F.length("v"), "v")).alias("word"))
    # words of triggers that indicate a label, weighed on a bounded sample of answered rows
    labels = matched.where("target_id >= 0").join(catalog.select(F.col("canonical_id").alias("target_id"), "disease", "action"), "target_id").select(F.col("key").alias("benefit_name"), F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("label")) for s in ("disease", "action")]).alias("ls"))
    rows = rows if "trigger" in rows.columns else rows.withColumn("trigger", F.lit(None).cast("string"))
    read = rows.where("coalesce(trigger, '') <> '' and coalesce(benefit_name, '') <> ''").select("row_id", "benefit_name", "trigger")
    sample = read.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE)
    seen = sample.join(labels, "benefit_name").select(F.explode(_trigger_words(F.col("trigger"))).alias("w"), "ls").select("w", F.explode("ls").alias("l")).groupBy("w", "l.slot", "l.label").agg(F.count(F.lit(1)).alias("n"))
    top = seen.groupBy("w", "slot").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n"), F.sum("n").alias("total"))
    indicators = top.where((F.col("n") >= SEEN) & (F.col("n") >= INDICATES * F.col("total"))).select("w", "slot", "label")
    # the triggers of all rows with an unknown word, each different one once
    texts = read.join(unknown.select(F.col("name").alias("benefit_name"), "slot", "word"), "benefit_name").select("slot", "word", "trigger").distinct()
    votes = texts.select("slot", "word", "trigger", F.explode(_trigger_words(F.col("trigger"))).alias("w")).join(indicators, ["w", "slot"]).select("slot", "word", "trigger", "label").distinct()
    per = votes.groupBy("slot", "word", "label").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("slot", "word").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n"), F.sum("n").alias("all"))
    many = texts.groupBy("slot", "word").agg(F.count(F.lit(1)).alias("texts"))
    sure = best.join(many, ["slot", "word"]).where((F.col("n") >= LEAST) & (F.col("n") >= AGREES * F.col("texts")) & (F.col("n") >= AGREES * F.col("all")))
    known = F.broadcast(lex.select("slot", "label", "v"))  # a known word of the label with something around it is no new word
    new = sure.join(known, (sure["slot"] == known["slot"]) & (sure["label"] == known["label"]) & F.col("word").contains(F.col("v")), "left_anti")
    return new.select("slot", "label", F.col("word").alias("variant"))


def _named(names: DataFrame) -> DataFrame:
    return names.select(F.lit("name").alias("slot"), F.col("name").alias("key"), F.col("name").alias("text"))


def matched_names(rows: DataFrame, names: DataFrame, synonyms: DataFrame, catalog: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(slot, key, target_id) of names (slot "name") and of (slot, key, text) lexicon variants that have a reference, words learned from the rows included."""
    names = cut(names, "names")
    words = lexicon(synonyms, catalog)
    first = match(_named(names), name_references(words, catalog))
    words = words.unionByName(cut(learned_words(rows, names, first, words, catalog), "learned"))
    left = _named(names.join(first.select(F.col("key").alias("name")), "name", "left_anti"))
    refs = name_references(words, catalog)
    if variants is not None:
        left, refs = left.unionByName(variants), refs.unionByName(variant_references(words, synonyms))
    return first.unionByName(match(left, refs))


def benefit_targets(rows: DataFrame, synonyms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, target_id) of every distinct benefit name that has a reference."""
    names = rows.where(F.trim(F.coalesce("benefit_name", F.lit(""))) != "").select(F.col("benefit_name").alias("name")).distinct()
    return matched_names(rows, names, synonyms, catalog).select(F.col("key").alias("name"), "target_id")


def with_unmatched(items: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Items with their target; those without one, found by anti-join, with -1."""
    return items.join(targets, on).unionByName(items.join(targets, on, "left_anti").withColumn("target_id", F.lit(-1).cast("long")))


def mapping_found(rows: DataFrame, synonyms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(src, item_id, target_id): every row whose benefit name is not literally canonical, and every unassigned variant."""
    named = rows.where(r"benefit_name rlike '(?U)[^\\s]'").select("row_id", F.col("benefit_name").alias("name")).join(bounded(catalog.select(F.col("canonical_name").alias("name")).where("name is not null").distinct()), "name", "left_anti")
    names = rows.where(r"benefit_name rlike '(?U)[^\\s]'").select(F.col("benefit_name").alias("name")).distinct()
    free = synonyms.where("label is null").select("syn_id", "slot", F.coalesce("variant", F.lit("")).alias("key"))
    found = matched_names(rows, names, synonyms, catalog, free.select("slot", "key", F.col("key").alias("text")).distinct())
    by_row = with_unmatched(named, found.where("slot = 'name'").select(F.col("key").alias("name"), "target_id"), ["name"])
    by_variant = with_unmatched(free, found.where("slot <> 'name'"), ["slot", "key"])
    return by_row.select(F.lit("row").alias("src"), F.col("row_id").alias("item_id"), "target_id").unionByName(by_variant.select(F.lit("variant").alias("src"), F.col("syn_id").alias("item_id"), "target_id"))
