"""Repair of text from scanned pages: words cut by line ends, misread characters, running headers, page numbers.

Two averaged perceptrons do the work. The character editor predicts one operation per character (keep, replace,
delete, insert) and, at a line end, join or space; its features are the characters around, read with all digits as
one, and how well the surrounding triple and its look-alike alternatives are known. Where no look-alike explains an
unknown triple, the editor weighs what is known to stand between the two characters before and the two after: a character
outside the look-alike table or a digit replaced, an added one deleted, a dropped one inserted, two read for one or one
for two. This goes over letters and numbers alone, because rows also differ in punctuation, white space and letter case,
which is formatting. Not seen: a digit read as another digit, digits dropped from or added to a number, marks and brackets
added or dropped, and most cases of two such errors within two characters. The line model tells running
headers and page numbers from text by the position of a line (first, inner or last line, blank lines around it, the line
before it unfinished), by how well the text goes on through the line and past it, by how much of it is known from running
text, and by its shape; it knows no wording of headers. What is known (triples, words, what stands between two characters and two) is
counted over all texts without line ends, as pieces with their counts, of which there are few. The perceptrons alone
are fitted on a bounded sample (``SAMPLE`` texts of each field), which gives clean texts, on which the damage of scanning is drawn again: every character is
once replaced by each of its look-alikes, characters are dropped, added, replaced at random and doubled, every blank and every place inside a word is once a line end, and
``LINES`` of the texts are broken into lines with made-up headers (words of drawn letters, and names of the table's insurers
and products) and page numbers between them. Pieces and sample texts that hold damage themselves are
recognised by words with a look-alike word many times as frequent, and are left out. Words that have lost a blank are no
known words where the same characters stand with the blank many times as often.

Inference goes over whole texts in one narrow pass; the pieces between brackets and note marks repeat so much that
most are answered from a bounded memo per worker.

Defined results: null and empty texts have no defects; texts of any length are read whole; line ends between words and
before numbered notes are no defects and come out as blanks; repeated rows each give their own result; without any
clean sample text nothing but furniture is found; rows without key and all other columns are ignored.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverline.session import cut

#: Texts of each field the models are fitted on.
SAMPLE = 6_000
#: A word is taken for damaged if a look-alike word is this many times as frequent in the sample.
RATIO = 10
#: What stands in a text is no misreading unless what is meant is this many times as frequent (or it was never seen).
RARE = 100
EPOCHS = 6
#: By how much the right kind of a line must win in training, so that it also wins with other wording.
MARGIN = 20.0
#: Places of clean text at which dropped, added and foreign characters are drawn.
PLACES = 3_000
#: Clean texts broken into lines for the line model.
LINES = 4_000
#: Names of insurers and products that made-up headers draw from.
NAMES = 400

# Letters that print alike, as pairs, by their place in a syllable.
_L, _V, _T = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ", " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
LEADS_ALIKE = "ㅇㄴ ㅁㅂ ㄱㅋ ㄷㅌ ㅈㅊ ㅅㅈ ㅂㅍ ㅇㅎ ㄴㄷ ㄷㄹ"
VOWELS_ALIKE = "ㅏㅑ ㅓㅕ ㅗㅛ ㅜㅠ ㅐㅔ ㅔㅖ ㅐㅒ ㅝㅟ ㅘㅚ ㅡㅜ ㅣㅓ ㅣㅏ ㅡㅗ ㅗㅜ ㅢㅣ"
TAILS_ALIKE = "ㅁㅂ ㅇㄴ ㄱㅇ ㄴㄷ ㄷㄹ ㅇㅁ ㅅㅈ ㅈㅊ ㄱㅋ ㄱㄹ"
DIGITS_ALIKE = {"0": "OoQD", "1": "lI", "2": "Z", "5": "S", "8": "B"}

# The digit a letter stands for, for letters beyond DIGITS_ALIKE.
READ_AS = {**{x: d for d, s in DIGITS_ALIKE.items() for x in s}, "b": "6", "G": "6", "g": "9", "q": "9", "z": "2", "s": "5", "|": "1"}

KEEP, REPLACE, DELETE, INSERT, JOIN, SPACE = "keep", "replace", "delete", "insert", "join", "space"


def _near(pairs: str, letters: str) -> dict[int, list[int]]:
    out = defaultdict(list)
    for p in pairs.split():
        a, b = letters.index(p[0]), letters.index(p[1])
        out[a].append(b)
        out[b].append(a)
    return out


_NEAR = (_near(LEADS_ALIKE, _L), _near(VOWELS_ALIKE, _V), _near(TAILS_ALIKE, _T))
_ALIKE: dict[str, tuple[str, ...]] = {}


def alike(ch: str) -> tuple[str, ...]:
    """Characters that print like ``ch``."""
    hit = _ALIKE.get(ch)
    if hit is None:
        if "가" <= ch <= "힣":
            o = ord(ch) - 0xAC00
            l, v, t = o // 588, o % 588 // 28, o % 28
            got = [chr(0xAC00 + (x * 21 + v) * 28 + t) for x in _NEAR[0][l]] + [chr(0xAC00 + (l * 21 + x) * 28 + t) for x in _NEAR[1][v]] + [chr(0xAC00 + (l * 21 + v) * 28 + x) for x in _NEAR[2][t]]
        elif ch in DIGITS_ALIKE:
            got = list(DIGITS_ALIKE[ch])
        else:
            got = [d for d, s in DIGITS_ALIKE.items() if ch in s]
        hit = _ALIKE[ch] = tuple(got)
    return hit


_DIGIT = str.maketrans("123456789\t\r\f\v\u00a0\u3000\u2009\u202f\u2007", "000000000" + " " * 9)


class Perceptron:
    """Averaged multi-class perceptron over sparse string features."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.w = weights or {}

    def scores(self, features: list) -> dict[str, float]:
        out: dict[str, float] = {}
        for f in features:
            for op, x in self.w.get(f, {}).items():
                out[op] = out.get(op, 0.0) + x
        return out

    def best(self, features: list, ops: tuple[str, ...]) -> str:
        s = self.scores(features)
        return max(ops, key=lambda o: (s.get(o, 0.0), o == ops[0]))

    def fit(self, examples: list[tuple[list, str, tuple[str, ...]]], epochs: int = EPOCHS, seed: int = 7, margin: float = 0.0) -> Perceptron:
        """Fits (features, right operation, operations to choose from); the right one must win by ``margin``."""
        w: dict = defaultdict(lambda: defaultdict(float))
        total: dict = defaultdict(lambda: defaultdict(float))
        stamp: dict = defaultdict(lambda: defaultdict(int))
        step, rng = 0, random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(examples)
            wrong = 0
            for features, gold, ops in examples:
                step += 1
                s: dict[str, float] = {}
                for f in features:
                    row = w.get(f)
                    if row:
                        for op, x in row.items():
                            s[op] = s.get(op, 0.0) + x
                guess = max(ops, key=lambda o: (s.get(o, 0.0) + (margin if o != gold else 0.0), o == ops[0]))
                if guess != gold:
                    wrong += 1
                    for f in features:
                        for op, d in ((gold, 1.0), (guess, -1.0)):
                            total[f][op] += (step - stamp[f][op]) * w[f][op]
                            stamp[f][op] = step
                            w[f][op] += d
            if not wrong:
                break
        for f, row in w.items():
            for op in row:
                total[f][op] += (step - stamp[f][op]) * row[op]
        self.w = {f: {op: x / max(step, 1) for op, x in row.items() if x} for f, row in total.items()}
        return self


def _bucket(n: int) -> str:
    return "0" if n <= 0 else "1" if n < 3 else "2" if n < 10 else "3"


def _likely(t: str, i: int, known: dict[str, int]) -> tuple[int, str]:
    """(count, character) of the look-alike of t[i] that is known best between its neighbours, or between look-alikes of one of them."""
    c, a, b = t[i], t[i - 1], t[i + 1]
    options = [(x, x.translate(_DIGIT)) for x in alike(c)]
    best = max(((known.get(a + m + b, 0), x) for x, m in options), default=(0, ""))
    if best[0]:
        return best
    pairs = [(known.get(a + m + y, 0), x) for x, m in options for y in alike(b)] + [(known.get(y + m + b, 0), x) for x, m in options for y in alike(a)]
    return max(pairs, default=(0, ""))


def edit_features(t: str, i: int, known: dict[str, int], seen: int = 0) -> list[str]:
    """Features of a character: itself and its neighbours, and how well its triple and its look-alikes' triples are known."""
    c, a, b = t[i], t[i - 1], t[i + 1]
    own = known.get(a + c + b, 0) - seen
    other = _likely(t, i, known)[0] if own < 3 else max((known.get(a + x.translate(_DIGIT) + b, 0) for x in alike(c)), default=0)
    left, right = known.get("<" + t[i - 2] + a + c, 0) - seen, known.get(">" + c + b + t[i + 2], 0) - seen
    k = _bucket(own) + _bucket(other)
    return ["b", "c" + c, "l" + a + c, "r" + c + b, "t" + a + c + b, "k" + k, "m" + k + _bucket(left) + _bucket(right), "n" + _bucket(other) + ("h" if "가" <= c <= "힣" else "d" if c.isdigit() else "x")]


Fillings = dict[str, dict[str, int]]


def letters(piece: str) -> tuple[str, list[int]]:
    """The letters and numbers of a masked piece, each number as one 0, between two blanks; and their positions in the piece."""
    out, at = [], []
    for i, c in enumerate(piece):
        if c.isalnum() and not (c == "0" and out and out[-1] == "0"):
            out.append(u if len(u := c.upper()) == 1 else c)
            at.append(i)
    return "  " + "".join(out) + "  ", at


def count_fillings(p: str, n: int, fillings: Fillings) -> None:
    """Adds what stands between two characters and the next two of padded letters: nothing, one character or two."""
    for size in range(3):
        for i in range(2, len(p) - 1 - size):
            row = fillings.setdefault(p[i - 2 : i] + p[i + size : i + size + 2], {})
            row[p[i : i + size]] = row.get(p[i : i + size], 0) + n


def _class(s: str) -> str:
    return "".join("h" if "가" <= c <= "힣" else "d" if c == "0" else "a" for c in s) or "-"


def _same_letter(a: str, b: str) -> bool:
    return unicodedata.normalize("NFKC", a).casefold() == unicodedata.normalize("NFKC", b).casefold()


#: Length read, length meant and the operation: foreign character, added, dropped, two read for one, one read for two, two foreign characters.
SPANS = ((1, 1, REPLACE), (1, 0, DELETE), (0, 1, INSERT), (2, 1, REPLACE), (1, 2, REPLACE), (2, 2, REPLACE))


def spans(p: str, i: int, fillings: Fillings, unseen: bool = False) -> list[tuple]:
    """(operation, characters read, characters meant, features) of what may stand at p[i] instead, best known first.

    ``unseen`` takes what stands there for never seen, as new words of clean text are."""
    out = []
    for read, meant, op in SPANS:
        got, right = p[i : i + read], p[i + read : i + read + 2]
        if len(right) < 2:
            continue
        row = fillings.get(p[i - 2 : i] + right)
        if not row:
            continue
        own = row.get(got, 0)
        n, best = max(((m, f) for f, m in row.items() if len(f) == meant and f != got and (read + meant < 3 or f not in got and got not in f and (read + meant < 4 or f[0] != got[0] and f[1] != got[1]))), default=(0, ""))
        if own * RARE > n and not unseen:
            continue
        if not n or "0" in (got if op == DELETE else best if op == INSERT else "") or read == meant and _same_letter(got, best) or "0" in best and (meant > 1 or read > 1):
            continue
        share = n / (sum(row.values()) - own)
        size = "0" if n < 3 else "1" if n < 10 else "2" if n < 100 else "3"
        k = f"S{op}{read}{meant}"
        sure = "0" if share < 0.5 else "1" if share < 0.9 else "2" if share < 0.99 else "3"
        edge = str(p[i - 2 : i].count(" ")) + str(right.count(" "))
        kind = _class(got) + ">" + _class(best)
        out.append((n, op, got, best, [k, k + "n" + size, k + "s" + sure, k + "ns" + size + sure, k + "e" + edge, k + "c" + kind, k + "ec" + edge + kind, k + "cs" + kind + sure, k + "es" + edge + sure, k + "o" + str(min(len(row), 4)) + sure, "Sf" + op + best, "Sg" + op + got]))
    out.sort(key=lambda x: -x[0])
    return [x[1:] for x in out]


def span_edits(piece: str, at: list[int], i: int, op: str, got: str, best: str) -> list[tuple]:
    """The operations by position in the piece that make ``best`` of ``got``, the i-th of its letters."""
    here = at[i] if i < len(at) else at[-1] + 1
    if best == "0":
        best = READ_AS.get(got, got)  # which digit it was can't always be told
    if got == "0" and (run := len(piece[here:]) - len(piece[here:].lstrip("0"))) > 1:
        return [(here, REPLACE, best)] + [(here + k, DELETE, "") for k in range(1, run)]
    if op == INSERT:
        after = at[i - 1] + 1 if i else 0
        while i and piece[after : after + 1] == "0" == piece[after - 1]:
            after += 1
        if here - after == 1 and piece[after] != " ":
            return [(after, REPLACE, best)]  # a mark was read for the character
        return [(here, INSERT, best)]
    if len(got) == len(best) == 2:
        return [(here, REPLACE, best[0]), (at[i + 1], REPLACE, best[1])]
    if len(got) == 2:
        there = at[i + 1]
        return [(here, REPLACE, best), (there, DELETE, "")]
    if len(best) == 2:
        return [(here, REPLACE, best[0]), (here + 1, INSERT, best[1])]
    return [(here, op, best)]


def apply(piece: str, ops) -> str:
    """The piece after ((position, operation, characters), …)."""
    chars = [*piece, ""]
    for i, op, x in ops:
        chars[i] = x + chars[i] if op == INSERT else x
    return "".join(chars)


def _span_examples(pieces: list[str], fillings: Fillings, rng: random.Random) -> list[tuple]:
    """Examples of dropped, added, foreign and doubled characters, and of clean text as if it had never been seen."""
    lines = sorted({letters(p)[0][2:-2] for p in pieces})
    places = [(p, i) for p in lines for i in range(len(p))]
    alphabet = sorted({c for p in lines for c in p if c.isalpha()}) or ["가"]
    out = []

    def add(clean: str, bad: str, i: int) -> None:
        # the operation that gives the clean text is right, every other one is not
        bad, at = letters(bad)
        plain = bad[2:-2]
        for j in range(max(i - 1, 0), min(i + 2, len(at) + 1)):
            for op, got, best, features in spans(bad, j + 2, fillings) if at else ():
                right = plain[:j] + best + plain[j + len(got) :] == clean
                out.append((features, op if right else KEEP, (KEEP, op)))

    for p, i in rng.sample(places, min(PLACES, len(places))):
        drawn = lambda: rng.choice(alphabet) if rng.random() < 0.6 else rng.choice("00ABEGLNRT") if rng.random() < 0.7 else chr(0xAC00 + rng.randrange(11172))
        add(p, p[:i] + p[i + 1 :], i)
        add(p, p[:i] + drawn() + p[i + 1 :], i)
        add(p, p[:i] + drawn() + drawn() + p[i + 1 :], i)
        add(p, p[:i] + drawn() + p[i + 2 :], i)
        add(p, p[:i] + drawn() + drawn() + p[i + 2 :], i)
        add(p, p[:i] + drawn() + p[i:], i)
        for op, _, _, features in spans("  " + p + "  ", i + 2, fillings, unseen=True):
            out.extend([(features, KEEP, (KEEP, op))] * 2)
    return out


def join_features(left: str, right: str, hyphen: bool, indent: bool, words: dict[str, int]) -> list[str]:
    """Features of a line end: the characters on both sides and whether the parts or the whole are known words."""
    a, b = left[-2:], right[:2]
    lw, rw = _TAIL.search(left).group(), _HEAD.match(right).group()
    whole = _bucket(words.get(lw + rw, 0)) if lw and rw else "-"
    parts = _bucket(words.get(lw, 0)) + _bucket(words.get(rw, 0))
    if whole == "0":
        w = lw + rw
        whole = "~" + _bucket(max((words.get(w[:i] + x + w[i + 1 :], 0) for i in range(len(w)) for x in alike(w[i])), default=0))
    return ["b", "h" + str(hyphen), "a" + a[-1:] + "|" + b[:1], "l" + a + "|" + b[:1], "r" + a[-1:] + "|" + b, "f" + a + "|" + b, "w" + whole, "p" + whole + parts, "x" + lw + "|" + rw, "i" + str(indent), "q" + whole + (_bucket(words.get(_PREFIX + lw + rw, 0)) if lw and rw else "-")]


#: Marks the entries of the word table that count the words beginning with a string.
_PREFIX = "<"
_TAIL, _HEAD = re.compile(r"[가-힣A-Za-z0-9]*$"), re.compile(r"[가-힣A-Za-z0-9]*")
_WORD = re.compile(r"[가-힣]{2,}")
_WORDS = re.compile(r"[가-힣A-Za-z0-9]+")

# Forms of page numbers; {n} a number, {w} a word.
PAGE_FORMS = ["{n}", "- {n} -", "– {n} –", "{n} / {n}", "{n}/{n}", "[{n}]", "({n})", "〔{n}〕", "<{n}>", "{w} {n}", "{w}. {n}", "{w}.{n}", "제{n}{w}", "{n}{w}", "{n} {w}", "{n} of {n}", "{w} {n} {w} {n}", "{w} {n}/{n}", "{w} {n} / {n}"]
PAGE_WORDS = ["p", "P", "pp", "Page", "page", "PAGE", "페이지", "쪽", "면"]
HEADER_MARKS = ["{}", "{}", "{}", "{}", "[{}]", "《{}》", "「{}」", "<{}>", "({})", "◆ {} ◆", "■ {}", "- {} -", "* {} *", "— {} —", "| {} |"]


def _word(rng: random.Random, least: int = 2, most: int = 6) -> str:
    """A word of drawn letters."""
    n = rng.randint(least, most)
    if rng.random() < 0.6:
        return "".join(chr(0xAC00 + rng.randrange(11172)) for _ in range(n))
    w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(n))
    return rng.choice((w, w.capitalize(), w.upper()))


def furniture(rng: random.Random, names: list[str], known: list[str]) -> tuple[str, str]:
    """A made-up page number or header and its kind; words of headers are drawn, names, or now and then ``known`` words."""
    n = lambda: str(rng.randint(1, 9) if rng.random() < 0.4 else rng.randint(10, 400))
    if rng.random() < 0.5:
        if rng.random() < 0.08:
            return "".join(rng.choice(("i", "v", "x", "ii", "iv", "xi")) for _ in range(rng.randint(1, 2))), "pageno"
        f = rng.choice(PAGE_FORMS)
        while "{n}" in f or "{w}" in f:
            f = f.replace("{n}", n(), 1).replace("{w}", rng.choice(PAGE_WORDS) if rng.random() < 0.6 else _word(rng, 1, 5), 1)
        return f, "pageno"
    words = [rng.choice(names) if names and rng.random() < 0.35 else rng.choice(known) if known and rng.random() < 0.15 else _word(rng) for _ in range(rng.choice((1, 2, 2, 3, 3, 4, 5)))]
    if len(words) > 1 and rng.random() < 0.3:
        words.append(rng.choice((n(), str(rng.randint(1000, 9_999_999)), f"제{n()}{_word(rng, 1, 2)}")))
    if len(words) > 1 and rng.random() < 0.2:
        words.insert(rng.randint(1, len(words) - 1), rng.choice("|·:-"))
    text = " ".join(words)
    if len(words) > 1 and rng.random() < 0.2:
        k = len(words[0])
        return rng.choice(("[{}]{}", "({}){}", "《{}》{}")).format(text[:k], text[k:]), "header"
    return rng.choice(HEADER_MARKS).format(text), "header"


def _unfinished(before: str) -> bool:
    """Whether a line ends within a sentence."""
    return re.search(r"[가-힣A-Za-z0-9,]\s*[-‐]?\s*$", before) is not None


def _edges(before: str, after: str) -> tuple[str, str]:
    """The last two characters before a line and the first two after it, which is all that is read of them."""
    return before.translate(_DIGIT).rstrip(" -‐­")[-2:], after.translate(_DIGIT).lstrip()[:2]


def _goes_over(a: str, b: str, known: dict[str, int]) -> str:
    """How well ``b`` is known to follow ``a``, with or without a blank."""
    return _bucket(max(known.get(a[-2:] + b[:1], 0), known.get(a[-1:] + b[:2], 0), known.get(a[-1:] + " " + b[:1], 0))) if a and b else "-"


def line_features(line: str, place: str, blank: bool, unfinished: bool, before: str, nexts: tuple[str, ...], known: dict[str, int]) -> list[str]:
    """Features of a line (or of a part of a line set off by wide blanks) between the edges of its neighbours: position, how the text goes on through it and past it, what of it is known, shape."""
    t = line.strip().translate(_DIGIT)
    shape = re.sub(r"0+", "0", t)
    shape = re.sub(r"[가-힣]+", "가", re.sub(r"[A-Za-zÀ-ÿ]+", "A", shape))
    tokens = re.findall(r"[가A0]|[^\s가A0]", shape)
    letters_, numbers = len(re.findall(r"[^\W\d_]", t)), shape.count("0")
    triples = [t[i : i + 3] for i in range(len(t) - 2)]
    share = sum(known.get(x, 0) > 2 for x in triples) / len(triples) if triples else -1
    k = "-" if share < 0 else "0" if share < 0.2 else "1" if share < 0.5 else "2" if share < 0.85 else "3"
    into, past = _goes_over(before, t[:2], known), max((_goes_over(before, x, known) for x in nexts), default="-")
    out = max((_goes_over(t[-2:], x, known) for x in nexts), default="-")
    size = "0" if letters_ == 0 else "1" if letters_ < 2 else "2" if letters_ < 5 else "3" if letters_ < 12 else "4"
    roman = "r" if re.fullmatch(r"(?i)[ivxlc]+", t) else "n"
    words = str(min(len(tokens), 6))
    return [
        "b", "p" + place, "z" + place + str(blank), "u" + place + str(unfinished), "k" + k, "kp" + k + place, "i" + into, "o" + out, "x" + past, "io" + into + out, "iox" + into + out + past, "kio" + k + into + out, "kx" + k + past,
        "n" + words, "d" + str(min(numbers, 3)) + size, "dk" + str(min(numbers, 3)) + size + k, "dn" + str(min(numbers, 3)) + words, roman, roman + place, "a" + shape[:1], "e" + shape[-1:], "ae" + shape[:1] + shape[-1:] + k,
        "dx" + str(min(numbers, 3)) + size + past, "dkx" + str(min(numbers, 3)) + size + k + past, *(["s" + shape, "sp" + shape + place, "sx" + shape + past] if len(tokens) <= 6 else []),
    ]


def line_contexts(raw: list[str], kept) -> Iterator[tuple[int, str, str, bool, str, tuple[str, ...]]]:
    """(index, line, place, blank, line before, lines after) of the lines with text; ``kept`` gives the last line that was taken for text so far."""
    full = [i for i, x in enumerate(raw) if x.strip()]
    for at, i in enumerate(full):
        place = "only" if len(full) == 1 else "first" if at == 0 else "last" if at == len(full) - 1 else "inner"
        yield i, raw[i], place, i + 1 < len(raw) and not raw[i + 1].strip(), kept(), tuple(raw[j] for j in full[at + 1 : at + 3])


class Model:
    """Editor, joiner and line model with what is known of clean text."""

    def __init__(self, editor, joiner, liner, counts):
        self.editor, self.joiner, self.liner, self.known, self.words, self.fillings = editor, joiner, liner, counts.known, counts.words, counts.fillings
        self.memo: dict[str, tuple] = {}
        self.joins: dict[tuple, str] = {}
        self.lines: dict[tuple, str] = {}
        self.windows: dict[str, list] = {}

    def __getstate__(self):
        return {k: {} if k in ("memo", "joins", "lines", "windows") else v for k, v in self.__dict__.items()}

    def edits(self, piece: str) -> tuple:
        """((position, operation, replacement), …) of a piece of text without line ends."""
        masked = piece.translate(_DIGIT)
        hit = self.memo.get(masked)
        if hit is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            hit = self.memo[masked] = tuple(self._edits(masked))
        return hit

    def _edits(self, t: str) -> Iterator[tuple]:
        p, changed, odd = "  " + t + "  ", {}, False
        for i in range(2, len(p) - 2):
            c = p[i]
            if self.known.get(p[i - 1 : i + 2], 0) > 2 and self.known.get("<" + p[i - 2 : i + 1], 0) > 2 and self.known.get(">" + p[i : i + 3], 0) > 2:
                continue
            odd = True
            if alike(c) and c != "0" and self.editor.best(edit_features(p, i, self.known), (KEEP, REPLACE)) == REPLACE:
                n, x = _likely(p, i, self.known)
                if n > 0:
                    changed[i - 2] = x
                    yield (i - 2, REPLACE, x)
        if not odd:
            return
        # what no look-alike explains, in the text with the look-alikes set right
        t = "".join(changed.get(i, c) for i, c in enumerate(t)).translate(_DIGIT)
        q, at = letters(t)
        after = 2
        for i in range(2, len(q) - 1 if at else 0):
            if i < after:
                continue
            for op, got, best in self._span(q[i - 2 : i + 4]):
                ops = span_edits(t, at, i - 2, op, got, best)
                if not any(k in changed for k, _, _ in ops) and self._unknown(t, ops):
                    yield from ops
                    after = i + max(len(got), 1)
                    break

    def _span(self, window: str) -> list[tuple]:
        """(operation, characters read, characters meant) the editor predicts after the second character of a window, which is all that ``spans`` reads."""
        hit = self.windows.get(window)
        if hit is None:
            if len(self.windows) > 300_000:
                self.windows.clear()
            hit = self.windows[window] = [(op, got, best) for op, got, best, features in spans(window, 2, self.fillings) if self.editor.best(features, (KEEP, op)) == op]
        return hit

    def _unknown(self, t: str, ops: list[tuple]) -> bool:
        """Whether a word that operations change is unknown as it stands; known words in new order are wording, not damage."""
        lo, hi = ops[0][0], ops[-1][0] + (ops[-1][1] != INSERT)
        if ops[0][1] == DELETE and not t[lo - 1 : lo].isalnum() and not t[hi : hi + 1].isalnum():
            return False
        if ops[0][1] == INSERT:  # it may also have ended the word before
            while lo and not t[lo - 1].isalnum():
                lo -= 1
        left, right = _TAIL.search(t[:lo]).group(), _HEAD.match(t[hi:]).group()
        became = left + apply(t[lo:hi], [(i - lo, o, x) for i, o, x in ops]) + right
        meant = max((self.words.get(w.translate(_DIGIT), 0) for w in _WORDS.findall(became)), default=0)
        return any(self.words.get(w, 0) < 3 or self.words[w] * RARE <= meant for w in _WORDS.findall(left + t[lo:hi] + right))

    def line_kind(self, part: str, place: str, blank: bool, before: str, nexts: tuple[str, ...]) -> str:
        """text, header or pageno."""
        left = _edges(before, "")[0]
        key = (part.strip().translate(_DIGIT), place, blank, _unfinished(before), left, tuple(_edges("", x)[1] for x in nexts))
        hit = self.lines.get(key)
        if hit is None:
            if len(self.lines) > 300_000:
                self.lines.clear()
            hit = self.lines[key] = self.liner.best(line_features(*key, self.known), ("text", "header", "pageno"))
        return hit

    def breaks(self, left: str, right: str, hyphen: bool, indent: bool) -> str:
        m = (left.translate(_DIGIT), right.translate(_DIGIT))
        lw, rw = _TAIL.search(m[0]).group(), _HEAD.match(m[1]).group()
        key = (lw, rw, m[0][-2:], m[1][:2], hyphen, indent)
        hit = self.joins.get(key)
        if hit is None:
            if len(self.joins) > 300_000:
                self.joins.clear()
            hit = self.joins[key] = self.joiner.best(join_features(*m, hyphen, indent, self.words), (SPACE, JOIN))
        return hit


_PIECE = re.compile(r"[^|()\[\]]+|[|()\[\]]")
_NOTE = re.compile(r"\s*(?:\d{1,2}\.|\d{1,2}\)|[①-⑳]|※|주\s*\d?\))(?:\s|$)")


def repair(text: str | None, model: Model) -> tuple[str | None, list[str]]:
    """The text as continuous paragraphs, and the kinds of damage found in it."""
    if not text:
        return text, []
    found: set[str] = set()
    if "\n" in text:
        text = _unwrap(text, model, found)
    out = []
    for m in _PIECE.finditer(text):
        piece = m.group()
        ops = model.edits(piece) if len(piece) > 1 else ()
        if ops:
            found.add("misread")
            piece = apply(piece, ops)
        out.append(piece)
    return "".join(out), sorted(found)


def without_furniture(text: str, model: Model, found: set[str]) -> list[str]:
    """The lines of a text that are neither headers nor page numbers, noting these."""
    kept: list[str] = []
    for _, line, place, blank, before, nexts in line_contexts(text.split("\n"), lambda: kept[-1] if kept else ""):
        parts = [x for x in re.split(r"\s{3,}", line.strip()) if x] if re.search(r"\S\s{3,}\S", line) else [line]
        kinds = [model.line_kind(p, place, blank, before, nexts) for p in parts]
        if all(x != "text" for x in kinds):
            found.update(kinds)
            continue
        kept.append(line)
    return kept


def _unwrap(text: str, model: Model, found: set[str]) -> str:
    """Takes out furniture lines and joins the rest, noting header, pageno and split_word."""
    kept = without_furniture(text, model, found)
    if not kept:
        return ""
    out = kept[0].rstrip() if len(kept) > 1 else kept[0]
    for line in kept[1:]:
        indent, right = line[:1].isspace(), line.strip() if line is not kept[-1] else line.lstrip()
        if _NOTE.match(right) and not out.endswith(("-", "‐")):
            out = out + " " + right
            continue
        hyphen = re.search(r"(?<=[가-힣A-Za-z0-9])[-‐­]$", out) is not None
        left = out[:-1] if hyphen else out
        if model.breaks(left, right, hyphen, indent) == JOIN:
            found.add("split_word")
            out = left + right
        else:
            out = out + " " + right
    return out


def _damaged(words: Counter) -> set[str]:
    """Words with a look-alike word that is many times as frequent (climbing over several characters), and long words with one of any other inner character that is ``RARE`` times as frequent."""
    bad, inner = set(), {}
    for w, n in words.items():
        for i in range(len(w) - 1 if len(w) > 4 else 0):
            k = w[:i] + "?" + w[i + 1 :]
            inner[k] = max(n, inner.get(k, 0))
    bad.update(w for w, n in words.items() if len(w) > 4 and any(inner[w[:i] + "?" + w[i + 1 :]] >= RARE * n for i in range(len(w) - 1)))
    for w, n in words.items():
        top, best = w, n
        for _ in range(4):
            step = max(((words.get(top[:i] + x + top[i + 1 :], 0), top[:i] + x + top[i + 1 :]) for i in range(len(top)) for x in alike(top[i])), default=(0, ""))
            if step[0] <= best:
                break
            best, top = step
        if best >= RATIO * n:
            bad.add(w)
    return bad


_LETTERS_IN_NUMBERS = re.compile(r"\d[OoQDlIZSbGBgq|]+(?=[\d.)~가-힣%\]]|$)|(?<![A-Za-z])[OolISB]\d*[OolISB]일")


KINDS = ("known", "word", "fill", "open", "shut")


def count_pieces(pieces: Iterable[tuple[str, int]], bad: set[str], kinds: tuple[str, ...] = KINDS) -> Counter:
    """Counts of (kind, key, filling) over masked pieces without damaged words: ``known`` contexts, ``word``s, ``fill``ings, and ``open`` and ``shut`` places with and without blank."""
    out: Counter = Counter()
    for p, n in pieces:
        if _LETTERS_IN_NUMBERS.search(p) or any(w in bad for w in _WORD.findall(p)):
            continue
        q = "  " + p + "  "
        for w in _WORDS.findall(p) if "word" in kinds else ():
            out["word", w, ""] += n
        if "fill" not in kinds:
            for i in range(1, len(q) - 1):
                out["known", q[i - 1 : i + 2], ""] += n
            continue
        for i in range(2, len(q) - 2):
            out["known", q[i - 1 : i + 2], ""] += n
            out["known", "<" + q[i - 2 : i + 1], ""] += n
            out["known", ">" + q[i : i + 3], ""] += n
            if q[i] == " ":
                out["open", q[i - 2 : i] + q[i + 1 : i + 3], ""] += n
            else:
                out["shut", q[i - 2 : i + 2], ""] += n
        fillings: Fillings = {}
        count_fillings(letters(p)[0], n, fillings)
        for k, row in fillings.items():
            for f, m in row.items():
                out["fill", k, f] += m
    return out


class Counts:
    """What is known of clean text, from the counts of ``count_pieces``; ``lost`` keeps words that have lost a blank, for the joiner to learn from."""

    def __init__(self, bad: set[str], counts: dict[tuple[str, str, str], int], lost: bool = False):
        self.bad, self.known, self.words, self.fillings = bad, {}, Counter(), {}
        spaced = {key: n for (kind, key, _), n in counts.items() if kind == "open"}
        joined = {key: n for (kind, key, _), n in counts.items() if kind == "shut"}
        for (kind, key, f), n in counts.items():
            if kind == "known":
                self.known[key] = n
            elif kind == "fill":
                self.fillings.setdefault(key, {})[f] = n
            elif kind == "word":
                w = " " + key + " "
                if not lost and any((o := spaced.get(w[i - 2 : i + 2], 0)) and o >= RATIO * joined.get(w[i - 2 : i + 2], 0) for i in range(2, len(w) - 1)):
                    continue
                self.words[key] += n
                for k in range(2, len(key) + 1):
                    self.words[_PREFIX + key[:k]] += n
        self.words = dict(self.words)


def _line_examples(clean: list[str], names: list[str], counts: Counts, rng: random.Random) -> list[tuple]:
    """Examples of lines: clean texts broken at random with furniture between the lines."""
    kinds = ("text", "header", "pageno")
    out: list[tuple] = []
    vocabulary = sorted(w for w in counts.words if not w.startswith(_PREFIX) and w.isalpha())
    for t in rng.sample(clean, min(LINES, len(clean))):
        inner = [k for k in range(2, len(t) - 1) if (t[k].isalnum() or t[k] in "(\"'") and not t[k - 1].isdigit()]
        if not inner:
            continue
        number = [m.end() for m in re.finditer(r"(?:^|\| ?)\d{1,2}\.(?= )", t)]
        digits = [k for k in inner if t[k].isdigit() and not t[k - 1].isalnum()]
        some = lambda x: number if number and x < 0.12 else digits if digits and x < 0.3 else inner
        cuts = sorted({rng.choice(some(rng.random())) for _ in range(rng.randint(1, 4))})
        raw: list[str] = []
        gold: list[str] = []
        for a, b in zip([0, *cuts], [*cuts, len(t)]):
            line = t[a:b]
            if b < len(t) and line[-1:].isalnum() and rng.random() < 0.2:
                line += rng.choice(("-", "- ", "‐"))
            raw.append(line.strip(" ") if rng.random() < 0.9 else "  " + line)
            gold.append("text")
            for _ in range(rng.choice((0, 0, 1, 1, 1, 2)) if b < len(t) else 0):
                f, kind = furniture(rng, names, vocabulary)
                raw.append(f)
                gold.append(kind)
                if rng.random() < 0.3:
                    raw.append("")
                    gold.append("")
        last = [""]
        for i, line, place, blank, before, nexts in line_contexts(raw, lambda: last[0]):
            left, rights = _edges(before, "")[0], tuple(_edges("", x)[1] for x in nexts)
            out.append((line_features(line, place, blank, _unfinished(before), left, rights, counts.known), gold[i], kinds))
            if gold[i] == "text":
                last[0] = line
    return out


def train(texts: list[str], seed: int = 7, everything: Counts | None = None, names: list[str] = ()) -> Model:
    """Fits the models on sample texts; every example stands once, however often its text occurs. The model knows ``everything``, by default what the sample holds."""
    rng = random.Random(seed)
    flat = [t for t in texts if t and "\n" not in t]
    bad = everything.bad if everything else _damaged(Counter(w for t in flat for w in _WORD.findall(t)))
    clean = [t for t in flat if not _LETTERS_IN_NUMBERS.search(t) and not any(w in bad for w in _WORD.findall(t))]
    pieces = Counter(m.group().translate(_DIGIT) for t in clean for m in _PIECE.finditer(t) if len(m.group()) > 1)
    own = Counts(bad, count_pieces(pieces.items(), bad), lost=True)
    known, words, fillings = own.known, own.words, own.fillings
    edits: dict[str, tuple] = {}
    for p, n in pieces.items():
        q = "  " + p + "  "
        for i in range(2, len(q) - 2):
            window = q[i - 2 : i + 3]
            if window in edits:
                continue
            edits[window] = (edit_features(q, i, known, seen=1), KEEP, (KEEP, REPLACE))
            for x in alike(q[i]) if q[i] != "0" else [y for d in DIGITS_ALIKE.values() for y in d]:
                spoiled = q[:i] + x + q[i + 1 :]
                if known.get(x.join((q[i - 1], q[i + 1])), 0) == 0:
                    edits.setdefault(spoiled[i - 2 : i + 3], (edit_features(spoiled, i, known), REPLACE, (KEEP, REPLACE)))
                    if i + 1 < len(q) - 2 and alike(q[i + 1]) and q[i + 1] != "0":
                        twice = spoiled[: i + 1] + rng.choice(alike(q[i + 1])) + spoiled[i + 2 :]
                        for j in (i, i + 1):
                            if known.get(twice[j - 1 : j + 2], 0) == 0:
                                edits.setdefault(twice[j - 2 : j + 3], (edit_features(twice, j, known), REPLACE, (KEEP, REPLACE)))
    joins: dict[tuple, tuple] = {}
    spoiled_joins: list[tuple] = []
    votes: dict[tuple, list] = {}
    for p, n in Counter(t.translate(_DIGIT) for t in clean).items():
        for k in range(1, len(p)):
            if p[k - 1] == " " or p[k] == "|" or p[k - 1] == "|":
                continue
            gold = p[k] == " "
            if not gold and not (p[k - 1].isalnum() or p[k - 1] in ")]}%\"'"):
                continue
            right = p[k : k + 25].lstrip()
            if right:
                v = votes.setdefault((p[max(0, k - 3) : k], right[:3]), [0, 0, p[max(0, k - 24) : k], right])
                v[gold] += n
    for (l3, r3), (joined, spaced, left, right) in votes.items():
        gold = SPACE if spaced > joined else JOIN  # blanks that formatting lost are outvoted
        spoiled_joins.append((left, right, gold))
        for hyphen, indent in ((False, False), (True, False), (False, True)) if gold == JOIN else ((False, False),):
            joins[(l3, r3, hyphen, indent)] = (join_features(left, right, hyphen, indent, words), gold, (SPACE, JOIN))
    for left, right, gold in spoiled_joins:
        for side in (0, 1):
            w = (_TAIL.search(left) if side == 0 else _HEAD.match(right)).group()
            at = [i for i in range(len(w)) if "가" <= w[i] <= "힣" and alike(w[i])]
            if at:
                i = rng.choice(at)
                v = w[:i] + rng.choice(alike(w[i])) + w[i + 1 :]
                x, y = (left[: len(left) - len(w)] + v, right) if side == 0 else (left, v + right[len(w) :])
                joins.setdefault((x[-4:], y[:4], "spoiled"), (join_features(x, y, False, False, words), gold, (SPACE, JOIN)))
    lines = _line_examples(clean, list(names), everything or own, random.Random(seed))
    return Model(Perceptron().fit([*edits.values(), *_span_examples(list(pieces), fillings, random.Random(seed))]), Perceptron().fit([*joins.values(), *[(["b", "hTrue"], JOIN, (SPACE, JOIN))] * 100]), Perceptron().fit(lines, margin=MARGIN), (everything or own))


def sample_texts(df: DataFrame, key: str, columns: list[str], n: int = SAMPLE) -> list[str]:
    """At most ``n`` rows' texts, chosen by the hash of their key (the same rows at every run)."""
    some = " or ".join(f"coalesce({c}, '') <> ''" for c in columns)
    step = max(1, df.count() // (4 * n))  # thins out what the tasks send, about four times the sample stays
    rows = df.select(F.xxhash64(key).alias("h"), *columns).where(F.pmod("h", F.lit(step)) == 0).where(some).orderBy("h").limit(n).collect()
    return [r[c] for r in rows for c in columns if r[c]]


def sample_names(rows: DataFrame, n: int = NAMES) -> list[str]:
    """Names of insurers and products of at most ``n`` rows, chosen by the hash of their key."""
    columns = [c for c in ("insurer", "product_name") if c in rows.columns]
    got = rows.select(*columns).distinct().orderBy(F.xxhash64(*columns)).limit(n).collect() if columns else []
    return sorted({r[c] for r in got for c in columns if r[c]})


def _pass(model: Model, fields: list[tuple[str, str]], with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple] = {}
        for pdf in batches:
            out: list[tuple] = []
            keys = pdf["key_id"].tolist()
            for column, field in fields:
                for key, text in zip(keys, pdf[column].tolist()):
                    if not text:
                        if with_text:
                            out.append((field, key, text, None))
                        continue
                    hit = seen.get(text)
                    if hit is None:
                        if len(seen) > 50_000:
                            seen.clear()
                        hit = seen[text] = repair(text, model)
                    if with_text:
                        out.append((field, key, hit[0], ",".join(hit[1])))
                    else:
                        out.extend((field, key, d) for d in hit[1])
            yield pd.DataFrame(out, columns=["field", "key_id", "text", "defects"] if with_text else ["field", "key_id", "defect"])

    return run


def running_texts(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(text): the three fields of both tables."""
    return rows.select(F.explode(F.array(F.col("trigger"), F.col("notes_summary"))).alias("text")).unionByName(entries.select(F.col("reduction_note").alias("text")))


def piece_counts(texts: DataFrame) -> DataFrame:
    """(piece, n): the masked pieces of all texts without line ends. They repeat so much that few are left."""
    digits = "".join(chr(k) for k in _DIGIT)
    masked = F.translate("text", digits, "".join(chr(k).translate(_DIGIT) for k in _DIGIT))
    flat = texts.where("text <> '' and instr(text, '\\n') = 0")
    pieces = flat.select(F.explode(F.regexp_extract_all(masked, F.lit(r"[^|()\[\]]+"), F.lit(0))).alias("piece")).where("length(piece) > 1")
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def count_all(texts: DataFrame, kinds: tuple[str, ...] = KINDS) -> Counts:
    """What is known of clean text, counted over all texts; only the counts of words and contexts come to the driver."""
    pieces = cut(piece_counts(texts), "pieces")
    words = pieces.select(F.explode(F.regexp_extract_all("piece", F.lit(_WORD.pattern), F.lit(0))).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    bad = _damaged(Counter({r.w: r.n for r in words.collect()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Counter = Counter()
        for pdf in batches:
            out.update(count_pieces(zip(pdf["piece"], pdf["n"].tolist()), bad, kinds))
        yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["kind", "k", "f", "n"])

    counted = pieces.mapInPandas(run, "kind string, k string, f string, n long").groupBy("kind", "k", "f").agg(F.sum("n").alias("n"))
    return Counts(bad, {(r.kind, r.k, r.f): r.n for r in counted.collect()})


def fit_model(rows: DataFrame, entries: DataFrame) -> Model:
    """Model fitted on bounded samples of both tables, with the counts of all texts."""
    sample = sample_texts(rows, "row_id", ["trigger", "notes_summary"]) + sample_texts(entries, "entry_id", ["reduction_note"])
    return train(sample, everything=count_all(running_texts(rows, entries)), names=sample_names(rows))


def defects_found(rows: DataFrame, entries: DataFrame, model: Model | None = None) -> DataFrame:
    """(field, key_id, defect), one row per damaged text and kind of damage."""
    model = model or fit_model(rows, entries)
    schema = "field string, key_id long, defect string"
    a = rows.where("row_id is not null").select(F.col("row_id").alias("key_id"), "trigger", "notes_summary").mapInPandas(_pass(model, [("trigger", "trigger"), ("notes_summary", "notes_summary")], False), schema)
    b = entries.where("entry_id is not null and coalesce(reduction_note, '') <> ''").select(F.col("entry_id").alias("key_id"), "reduction_note").mapInPandas(_pass(model, [("reduction_note", "reduction_note")], False), schema)
    return a.unionByName(b)


def repaired(rows: DataFrame, entries: DataFrame, model: Model | None = None) -> DataFrame:
    """(field, key_id, text, defects): every text in continuous form."""
    model = model or fit_model(rows, entries)
    schema = "field string, key_id long, text string, defects string"
    a = rows.where("row_id is not null").select(F.col("row_id").alias("key_id"), "trigger", "notes_summary").mapInPandas(_pass(model, [("trigger", "trigger"), ("notes_summary", "notes_summary")], True), schema)
    b = entries.where("entry_id is not null").select(F.col("entry_id").alias("key_id"), "reduction_note").mapInPandas(_pass(model, [("reduction_note", "reduction_note")], True), schema)
    return a.unionByName(b)
