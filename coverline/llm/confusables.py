"""Text that looks the same but is written with other characters.

One form per text: invisible characters go, widths and compatibility forms fold, combining sequences compose, and
look-alike letters take the spelling of one consistent script. For the last step every letter of a token has a set of
scripts in which a character of the same look exists; the sets of a token are intersected (Han, Hangul and Kana
resolve together with any of East Asia's writing systems). A token whose letters come from several scripts is mixed
and is re-spelled in the script of the intersection; a token wholly in one foreign script that could be spelled
wholly in an expected script is a whole-script confusable and is re-spelled too; a token with no common script
(true Greek or Cyrillic words) stays as it is.

Defined results: null stays null and "" stays ""; ordinary blanks, letter case and wording are never changed, so names
that differ in them stay different; text of any length is read whole; repeated texts are normalised once per Python
worker (bounded memo); rows without a reference that looks the same give no row; ties (several references of one look)
give the lowest reference id.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of one look in Greek, Cyrillic and Latin script.
LOOKALIKES = {
    "Grek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοανιρυκϲσγτ", "ABEZHIKMNOPTYXCjoavipukcoyt"),
    "Cyrl": ("АВЕЅІЈКМНОРСТУХҮԌԚԜабеоркмнстухѕіјԁԛԝһӏгЬ", "ABESIJKMHOPCTYXYGQWa6eopkmhctyxsijdqwhlrb"),
    "Armn": ("ՕՍԼսոօհ", "OULunoh"),
    "Cher": ("ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHIJKLMPRSTVWZ"),
}
#: Look-alikes that are too loose to say that two texts look the same.
LOOSE = set("σγτбкмнтгЬ")
# Marks of one look, first the ordinary one.
MARKS = ["·‧・･•∙⋅ㆍᆞ᛫⸱ꞏ", "-‐‑‒–—−﹣－―", "'‘’ʼ′＇", '"“”″＂', "/∕⁄／", "~∼～〜", "…⋯"]
_MARK = {ord(o): m[0] for m in MARKS for o in m[1:]}
_KEEP_MARKS = {ord(o): m[0] for m in (MARKS[0], MARKS[1], MARKS[4], MARKS[5]) for o in m[1:]}

LATIN_OF: dict[str, dict[str, str]] = {}
for _script, (_from, _to) in LOOKALIKES.items():
    LATIN_OF[_script] = dict(zip(_from, _to, strict=True))
_TO_LATIN = {c: (s, t) for s, m in LATIN_OF.items() for c, t in m.items() if c not in LOOSE}
_FROM_LATIN: dict[str, dict[str, str]] = {s: {} for s in LATIN_OF}
for _c, (_s, _t) in _TO_LATIN.items():
    _FROM_LATIN[_s].setdefault(_t, _c)

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻]|[\U000e0000-\U000e0fff]")
_SPACES = re.compile("[   -     　]")
_TOKEN = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile("[Ͱ-֏Ꭰ-᏿ἀ-῿]")


def script(ch: str) -> str:
    """Script of a letter: the look-alike scripts by name, all of East Asia as one augmented set, everything else by the first word of its name."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        return "Latn"
    if 0x370 <= o < 0x400 or 0x1F00 <= o <= 0x1FFF:
        return "Grek"
    if 0x400 <= o < 0x530:
        return "Cyrl"
    if 0x530 <= o < 0x590:
        return "Armn"
    if 0x13A0 <= o < 0x1400:
        return "Cher"
    if 0x1100 <= o < 0x1200 or 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00:
        return "Asia"
    return unicodedata.name(ch, "?").split(" ")[0]


def scripts_of(ch: str) -> frozenset[str]:
    """The resolved script set of a letter: its own script and every script with a letter of the same look."""
    own = script(ch)
    if own == "Asia":
        return frozenset({"Asia", *LATIN_OF, "Latn"})  # East Asian text stands with any script
    latin = ch if own == "Latn" else _TO_LATIN.get(ch, ("", ""))[1]
    return frozenset({own, *({"Latn"} if latin else ()), *(s for s, m in _FROM_LATIN.items() if latin and latin in m)})


def consistent(token: str, expected: tuple[str, ...] = ("Latn",)) -> str:
    """The token spelled in one script, if it is mixed or a whole-script confusable of an expected script."""
    if not _SUSPECT.search(token):
        return token
    sets = [scripts_of(c) for c in token]
    common = frozenset.intersection(*sets)
    own = {script(c) for c in token} - {"Asia"}
    target = next((s for s in expected if s in common), None)
    if target is None and len(own) > 1:
        target = next((s for s in sorted(own) if s in common), None)
    if target is None:
        return token
    if target == "Latn":
        return "".join(_TO_LATIN.get(c, ("", c))[1] for c in token)
    back = _FROM_LATIN[target]
    return "".join(c if script(c) in (target, "Asia") else back.get(_TO_LATIN.get(c, ("", c))[1], c) for c in token)


def one_form(text: str | None) -> str | None:
    """The one form of a text that all texts of the same look share."""
    if text is None or text.isascii():
        return text
    t = _SPACES.sub(" ", _INVISIBLE.sub("", text))
    t = unicodedata.normalize("NFKC", t).translate(_KEEP_MARKS)
    t = _INVISIBLE.sub("", t)
    if _SUSPECT.search(t):
        t = _TOKEN.sub(lambda m: consistent(m.group()), t)
    return t


_MEMO: dict[str, str | None] = {}
_MEMO_LIMIT = 200_000


def _remembered(text: str | None) -> str | None:
    if text is None:
        return None
    hit = _MEMO.get(text)
    if hit is None:
        if len(_MEMO) >= _MEMO_LIMIT:
            _MEMO.clear()
        hit = _MEMO[text] = one_form(text)
    return hit


def _same_look(text: pd.Series) -> pd.Series:
    return pd.Series([_remembered(x) for x in text], dtype=object)


#: ``one_form`` over batches; not deterministic by name only, so that no filter makes Spark run it twice.
same_look = F.pandas_udf(_same_look, T.StringType()).asNondeterministic()


def latin_translate(text: Column) -> Column:
    """Look-alikes and full-width forms to Latin and ASCII with built-in functions only (for SQL-only operators)."""
    wide = [(chr(o + 0xFEE0), chr(o)) for o in range(0x21, 0x7F)]
    pairs = [*wide, *((c, t) for c, (_, t) in _TO_LATIN.items())]
    folded = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    for n, roman in enumerate(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")):
        folded = F.replace(F.replace(folded, F.lit(chr(0x2160 + n)), F.lit(roman)), F.lit(chr(0x2170 + n)), F.lit(roman.lower()))
    return folded


def looks_found(rows: DataFrame, catalog: DataFrame, contracts: DataFrame) -> DataFrame:
    """(field, row_id, ref_id) of names that look like their reference without being written like it.

    Benefit names meet the catalogue (a fixed table, small enough to broadcast), contract names the contracts of the same
    product in one shuffle on (product, form); a product that holds a third of all rows is split over its contracts.
    """
    forms = rows.where("coalesce(benefit_name, '') <> '' or coalesce(contract_name, '') <> ''").select(
        "row_id", "product_name", "benefit_name", "contract_name", same_look("benefit_name").alias("bf"), same_look("contract_name").alias("cf")
    )
    cat = catalog.where("coalesce(canonical_name, '') <> ''").select(same_look("canonical_name").alias("bf"), F.col("canonical_name").alias("ref"), F.col("canonical_id").alias("id"))
    con = contracts.where("coalesce(contract_name, '') <> ''").select("product_name", same_look("contract_name").alias("cf"), F.col("contract_name").alias("ref"), F.col("contract_id").alias("id"))
    least = lambda df, *keys: df.groupBy(*keys).agg(F.min_by(F.struct("ref", "id"), "id").alias("m"), F.collect_set("ref").alias("refs"))
    b = forms.join(least(cat, "bf"), "bf").where(~F.array_contains("refs", F.col("benefit_name"))).select(F.lit("benefit_name").alias("field"), "row_id", F.col("m.id").alias("ref_id"))
    c = forms.join(least(con, "product_name", "cf"), ["product_name", "cf"]).where(~F.array_contains("refs", F.col("contract_name"))).select(F.lit("contract_name").alias("field"), "row_id", F.col("m.id").alias("ref_id"))
    return b.unionByName(c)
