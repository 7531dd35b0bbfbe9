"""Slot lexicons and the canonical key. A lexicon is a small driver-side value that becomes a literal array, so keys are plain expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.functions import fixed
from coverline.functions.bind import let
from coverline.functions.text import match_text, without_type

#: Spellings a lexicon may hold; more belong into a table joined by operators, not into literals.
MAX_SPELLINGS = 5_000


@dataclass(frozen=True)
class Lexicon:
    """Spellings by slot: slot -> [(spelling, label)] in order, each spelling once per slot and without blanks."""

    slots: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    @staticmethod
    def of(tables: dict[str, dict[str, list[str]]]) -> Lexicon:
        return Lexicon().merged(tables)

    def merged(self, tables: dict[str, dict[str, list[str]]]) -> Lexicon:
        """This lexicon with further tables; a spelling that is known already keeps its label."""
        out = {s: dict(v) for s, v in self.slots.items()}
        for slot, labels in tables.items():
            if slot.startswith("_"):
                continue
            known = out.setdefault(slot, {})
            for label, spellings in labels.items():
                for s in spellings:
                    if flat := "".join(s.split()):
                        known.setdefault(flat, label)
        if sum(map(len, out.values())) > MAX_SPELLINGS:
            raise ValueError(f"a lexicon holds at most {MAX_SPELLINGS} spellings")
        return Lexicon({s: list(v.items()) for s, v in out.items()})

    @staticmethod
    def from_table(df: DataFrame) -> Lexicon:
        """Lexicon of a (slot, label, variant, ord) table; rows without a label are proposals and left out."""
        rows = df.where("label is not null and variant is not null").select("slot", "label", "variant", "ord", "label_id").limit(MAX_SPELLINGS + 1).collect()
        tables: dict[str, dict[str, list[str]]] = {}
        for r in sorted(rows, key=lambda r: (r["slot"], r["label_id"], r["ord"])):
            tables.setdefault(r["slot"], {}).setdefault(r["label"], []).append(r["variant"])
        return Lexicon.of(tables)

    def entries(self, slot: str) -> list[tuple[str, str]]:
        return self.slots.get(slot, [])

    def labels(self, slot: str) -> list[str]:
        return list(dict.fromkeys(label for _, label in self.entries(slot)))


DEFAULT = Lexicon.of({"action": fixed.ACTION, "disease": fixed.DISEASE, "condition": fixed.CONDITION, "type": fixed.TYPE})


def slot_label(t: Column, lexicon: Lexicon, slot: str) -> Column:
    """Label of the longest spelling in a text, of equally long ones the first; "" without any."""
    by_length = sorted(enumerate(lexicon.entries(slot)), key=lambda x: (-len(x[1][0]), x[0]))
    if not by_length:
        return F.lit("")

    def longest(x: Column) -> Column:
        out = None
        for _, (s, label) in by_length:  # the first that is contained ends the search
            out = F.when(x.contains(s), label) if out is None else out.when(x.contains(s), label)
        return out.otherwise("")

    return let(t, longest)


def masked(t: Column, lexicon: Lexicon, slot: str = "action") -> Column:
    """Spellings of a slot blanked out, longest first."""
    words = sorted((s for s, _ in lexicon.entries(slot)), key=len, reverse=True)
    if not words:
        return t
    blank = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(" " * len(w)).alias("b")) for w in words])
    return F.aggregate(blank, t, lambda acc, x: F.replace(acc, x["w"], x["b"]))


def canonical_key(name, lexicon: Lexicon = DEFAULT) -> Column:
    """Condition, disease and action of a name joined by "|"; a name without any is its own key, a blank one ""."""

    def key_of(whole: Column, bare: Column) -> Column:
        action = let(slot_label(bare, lexicon, "action"), lambda x: F.when(x != "", x).otherwise(slot_label(whole, lexicon, "action")))
        parts = F.array(slot_label(bare, lexicon, "condition"), slot_label(masked(bare, lexicon), lexicon, "disease"), action)
        return let(F.array_join(F.filter(parts, lambda p: p != ""), "|"), lambda key: F.when(key == "", whole).otherwise(key))

    return let(match_text(name), lambda whole: F.when(whole == "", "").otherwise(let(without_type(whole), lambda bare: key_of(whole, bare))))


def key_action(key: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The last part of a key that is an action, else ""."""
    labels = lexicon.labels("action")
    return F.coalesce(F.try_element_at(F.filter(F.split(key, r"\|"), lambda p: p.isin(labels)), F.lit(-1)), F.lit(""))


def is_raw(name, key: Column) -> Column:
    """Whether a key is only the name itself."""
    return (key == match_text(name)) & ~key.contains("|")
