"""Sentence units of documents in any mix of languages and scripts.

A pushdown automaton walks over the marks of a paragraph (terminators, quotation marks, brackets, ellipses and, in
scripts written without terminators, blanks). Quotations, brackets and list levels are pushed and popped; a
terminator ends a unit only where the stack is empty. What a full stop means is decided by tries of abbreviations
(read backwards from the stop), the characters around it (decimals, dates, initials, addresses, missing blanks)
and the script of the word before it. After a quotation that ends with a terminator the words that follow decide
whether the sentence goes on.

Defined results: null, empty and blank texts give no units; a text without any terminator is one unit per paragraph;
units never overlap, are ordered, carry no surrounding white space, and cover all text but white space; unclosed
quotations and brackets are ignored, so they can't swallow the rest of a paragraph; offsets count characters (code
points) from 0, end exclusive; texts of any length are read whole; repeated documents each give their own units;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Abbreviations by what may follow them.
NEVER_LAST = (
    "mr mrs ms dr prof st sr jr rev hon sec secs art arts no nos fig figs vol ch bldg dept e.g i.e vs approx incl excl cf ca viz al ed eds p pp "
    "jan feb mar apr jun jul aug sep sept oct nov dec ver rev ref tel ext est mt ft para cl डॉ श्री श्रीमती कु सं पृ प्रो"
).split()
MAY_BE_LAST = "etc co ltd inc corp ph.d m.d b.a m.a a.m p.m yr yrs mo mos hr hrs min mins u.s u.k u.n e.u d.c usa dept ave blvd rd".split()
#: Words that open a sentence after an abbreviation that may be its last word.
OPENERS = set("The A An This That These Those It He She We You They I If When What Where Why How Is Are Was Were Do Does In On At For No Not Please As Per Note".split())
# Words that carry a sentence on after a quotation.
AFTER_QUOTE = re.compile(r"(?:이?라고|이?라는|이?라며|이?라면서|이?란|라|하고|하며|하면서|하는|하였|했|고(?=[\s가-힣])|며|는|은|이|가|을|를|로|으로|에|에서|의|와|과|도|만|조차|처럼|같은)|(?:และ|แล้ว|หรือ|แต่|โดย|ซึ่ง|ก่อน|จาก|เมื่อ|ต่อ|ที่|ใน|ของ)|(?:और|तथा|लेकिन|कहकर|फिर|ऐसा|जैसा|या|के|की|का|को|से|पर|में|ने|था|थी|है|हैं)(?![ऀ-ॿ])")
THAI_GOES_ON = re.compile(r"แล้ว|และ|หรือ|แต่|โดย|ซึ่ง|เพราะ|จึง|ก่อน|ต่อ|เป็น|คือ|ของ|ใน|ที่|กับ|ถึง")
THAI_LEADS_IN = re.compile(r"(?:นอกจากนี้|ทั้งนี้|อย่างไรก็ตาม|ดังนั้น|อนึ่ง|เช่น|ได้แก่|คือ|ว่า|และ|หรือ|กรณีนี้|ในกรณีนี้|หมายเหตุ|โปรดทราบ|เพิ่มเติม)$")
THAI_LABELS = ("หมายเลข", "ข้อที่", "ข้อ", "มาตรา", "เลขที่", "ฉบับที่", "หน้า", "ส่วนที่", "บทที่", "ภาคผนวก")
#: Longest word of THAI_LEADS_IN.
_LEADS_IN = 24
#: Initials are at most so many letters.
_INITIALS = 16

_PAIRS = {"“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "«": "»", "„": "”"}
_CLOSERS = set(_PAIRS.values()) | {"’"}
_QUOTES = set("”」』\"'’»")
_FULL = set("。！？．।॥؟｡")
_EVENT = re.compile(r"[.!?…。！？．।॥؟｡“”‘’「」『』（）()\[\]{}《》〈〉【】〔〕«»„\"']")
_EVENT_THAI = re.compile(r"[.!?…。！？．।॥؟｡“”‘’「」『』（）()\[\]{}《》〈〉【】〔〕«»„\"']|[^\S\x00]+")
_THAI = re.compile(r"[฀-๿຀-໿ក-៿က-႟]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_MARKER = re.compile(r"[^\S\n]*(?:(?P<bullet>[-•*·‣▪◦●○■□◆◇※–—∙])[^\S\n]+|(?P<paren>\(\d{1,3}\))|(?P<dot>\d{1,3}[.)])(?=[^\S\n])|(?P<circle>[①-⑳❶-❿㉠-㉻ⓐ-ⓩ⑴-⒇])|(?P<hangul>[가나다라마바사아자차카타파하][.)])(?=[^\S\n])|(?P<alpha>[A-Za-z][.)])(?=[^\S\n])|(?P<parenh>\([가-하a-z]\)))")
_DATE = re.compile(r"(?:^|(?<=\D))\d{4}\.[ \n]?\d{1,2}\.(?:[ \n]?\d{1,2}\.)?|(?:^|(?<=\D))\d{1,2}\.\s\d{1,2}\.(?=[\s가-힣])")
_WORD_ENDS = set("()[]{}“”‘’「」『』（）\"',;:/")
_CARRIES_ON = re.compile(r"이?라고|이?라는|이?라며|이?라면서|이?란|하고|하며|하면서|하는|하였|했|고\s|며\s")


class Trie:
    """Trie of abbreviations, read backwards from a full stop; keeps the class of each."""

    def __init__(self, classes: dict[str, Iterable[str]]):
        self.root: dict = {}
        for name, words in classes.items():
            for w in words:
                node = self.root
                for ch in reversed(w):
                    node = node.setdefault(ch, {})
                node[""] = name

    def before(self, text: str, stop: int, start: int = 0) -> str | None:
        """Class of the longest abbreviation that ends right before ``stop`` and starts at a word start or at ``start``."""
        node, i, found = self.root, stop - 1, None
        while i >= start:
            node = node.get(text[i].lower())
            if node is None:
                break
            if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in ".@")):
                found = node[""]
            i -= 1
        return found


_ABBREVIATIONS = Trie({"may": MAY_BE_LAST, "never": NEVER_LAST})


def _is_cjk(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿"


def _is_hangul(ch: str) -> bool:
    return "가" <= ch <= "힣"


def _word_before(t: str, start: int, i: int, last: list[int]) -> int:
    """Start of the word that ends before ``i``; ``last`` holds where the search before ended and what it found, so that a long word is walked over once."""
    j = i
    while j > max(start, last[0]) and not t[j - 1].isspace() and t[j - 1] not in _WORD_ENDS:
        j -= 1
    if j == last[0] and j > start:
        j = last[1]
    last[:] = [i, j]
    return max(j, start)


def _stop_ends(t: str, i: int, end: int, start: int, dates: tuple[list[int], list[int]], last: list[int]) -> bool:
    """Whether the full stop at i (the last of its run before ``end``) ends the unit that began at ``start``."""
    n = len(t)
    prev = t[i - 1] if i > start else ""
    nxt = t[end] if end < n else ""
    if nxt == "":
        return True
    k = bisect_right(dates[0], i) - 1
    if k >= 0 and i < dates[1][k]:
        return False
    j = end
    while j < n and t[j].isspace():
        j += 1
    spaced, follow = j > end, t[j] if j < n else ""
    if follow == "":
        return True
    if follow in ",;:、，)]）」』”’%" and not (follow in "”’" and spaced):
        return False
    if prev.isdigit() and nxt.isdigit():
        return False
    word = _word_before(t, start, i, last)
    w = t[word:i]
    if not spaced:
        if nxt.isascii() and (nxt.islower() or nxt.isdigit() or nxt in "@_/-="):
            return (_is_hangul(prev) or prev in _CLOSERS) and nxt.isdigit()
        if prev.isdigit() and not (nxt in "“‘「『\"'(") and not nxt.isupper():
            return False
        if _is_hangul(prev) or prev in _CLOSERS:
            return True
        if nxt.isupper() and nxt.isascii():
            if "@" in w or not (len(w.rsplit(".", 1)[-1]) >= 2 or not prev.isalnum()) or _ABBREVIATIONS.before(t, i, start):
                return False
            return not (end + 1 < n and t[end + 1] == ".")
    kind = _ABBREVIATIONS.before(t, i, start)
    if kind == "never":
        return False
    if prev.isascii() and prev.isalpha():
        initials = len(w) < 2 * _INITIALS and re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]|[A-Z]", w) is not None
        if kind == "may" or initials:
            if not (follow.isupper() and follow.isascii()):
                return follow in "“\"‘'" and kind == "may"
            return re.match(r"[A-Za-z]+", t[j:]).group() in OPENERS and not (initials and len(w) == 1)
        if follow.isascii() and follow.islower():
            return False
        return True
    if prev.isdigit():
        if w.isdigit() and len(w) <= 3 and word == start:
            return False
        return not (follow.isascii() and follow.islower())
    if w and word == start and re.fullmatch(r"[가-하]|[ivxIVX]{1,4}", w):
        return False
    if follow.isascii() and follow.islower() and not _is_hangul(prev) and not _is_cjk(prev) and prev not in ")]":
        return False
    return True


def _goes_on(t: str, close: int, quote: bool) -> bool:
    """Whether a sentence goes on after the quotation or bracket that closed at ``close`` with a terminator inside.

    Hangul has no capitals that would show a new sentence: what follows a quotation on the same line belongs to it.
    """
    n, j = len(t), close
    while j < n and t[j].isspace():
        j += 1
    if j >= n:
        return False
    f, spaced = t[j], j > close
    if f in ".!?…。！？．।,;:、，；：)]）%":
        return True
    if not spaced:
        return not (f.isascii() and f.isupper()) and f not in "“「『‘"
    if f.isascii() and f.isalpha():
        return f.islower()
    if _is_hangul(f):
        return quote or AFTER_QUOTE.match(t, j) is not None and _CARRIES_ON.match(t, j) is not None
    if "฀" <= f <= "๿" or "ऀ" <= f <= "ॿ":
        return AFTER_QUOTE.match(t, j) is not None
    return f.isdigit()


def _matched(t: str, lo: int, hi: int, events: list[re.Match]) -> dict[int, int]:
    """Partner of every opening mark that is closed inside the paragraph (others are plain characters)."""
    stack: list[tuple[str, int]] = []
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack of every kind of mark
    pairs: dict[int, int] = {}

    def push(mark: str, i: int) -> None:
        open_at[mark].append(len(stack))
        stack.append((mark, i))

    def close(mark: str, i: int) -> None:
        top = open_at[mark][-1]
        pairs[stack[top][1]] = i
        while len(stack) > top:
            open_at[stack.pop()[0]].pop()

    for m in events:
        i, c = m.start(), t[m.start()]
        before, after = t[i - 1] if i > lo else " ", t[i + 1] if i + 1 < hi else " "
        if c in "\"'" or c == "’":
            mark = '"' if c == '"' else "'"
            inside = before.isalnum() and before.isascii() and after.isalnum() and after.isascii()
            if c != '"' and inside:
                continue
            if open_at[mark] and not (before.isspace() and not after.isspace()):
                close(mark, i)
            elif c != "’" and not after.isspace():
                push(mark, i)
        elif c == "‘":
            push("'", i)
        elif c in _PAIRS:
            push(_PAIRS[c], i)
        elif c in _CLOSERS and open_at[c]:
            close(c, i)
    return pairs


def _paragraph(t: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Units of one paragraph t[lo:hi] by the automaton."""
    text = t[lo:hi]
    thai = _THAI.search(text) is not None
    events = list((_EVENT_THAI if thai else _EVENT).finditer(text))
    pairs = _matched(text, 0, len(text), events)
    closes = {b: a for a, b in pairs.items()}
    spans = [m.span() for m in _DATE.finditer(text)] if "." in text else []
    dates = ([a for a, _ in spans], [b for _, b in spans])
    n, start, depth, skip, word = len(text), 0, 0, -1, [0, 0]

    def cut(at: int) -> tuple[int, int] | None:
        nonlocal start
        a, b = start, at
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        start = at
        return (lo + a, lo + b) if a < b else None

    for m in events:
        i, c = m.start(), text[m.start()]
        if i < skip:
            continue
        while start < i and text[start].isspace():
            start += 1
        if i in pairs:
            depth += 1
            continue
        if i in closes:
            depth -= 1
            if depth == 0:
                k = i - 1
                while k > closes[i] and (text[k].isspace() or text[k] in _CLOSERS or text[k] in "\"'"):
                    k -= 1
                if (text[k] in ".!?…" or text[k] in _FULL) and not _goes_on(text, i + 1, text[i] in _QUOTES):
                    bracket = text[i] not in _QUOTES
                    if not (bracket and closes[i] > start):
                        if u := cut(i + 1):
                            yield u
            continue
        if depth:
            continue
        if c.isspace():
            if _thai_space(text, i, m.end(), start):
                if u := cut(m.end()):
                    yield u
            continue
        end = i + 1
        while end < n and (text[end] in ".!?…" or text[end] in _FULL):
            end += 1
        run = text[i:end]
        last = end - 1
        if c in _FULL or any(x in _FULL for x in run):
            ends = True
        elif "!" in run or "?" in run:
            j = end
            while j < n and text[j].isspace():
                j += 1
            f = text[j] if j < n else ""
            ends = not (f in ",;:、，)" and f) and not (j > end and f.isascii() and f.islower() and f.isalpha())
        elif "…" in run or len(run) > 1:
            j = end
            while j < n and text[j].isspace():
                j += 1
            f = text[j] if j < n else ""
            ends = f == "" or (f.isascii() and f.isupper()) or (f in "“「『\"")
        elif c == ".":
            ends = _stop_ends(text, last, end, start, dates, word)
        else:
            continue
        skip = end
        if ends:
            if u := cut(end):
                yield u
    if u := cut(n):
        yield u


def _thai_label(t: str, start: int, i: int) -> int | None:
    """Start of a label with its number that ends before ``i``."""
    while i > start and (t[i - 1].isdigit() or t[i - 1] in ".,"):
        i -= 1
    while i > start and t[i - 1].isspace():
        i -= 1
    found = [i - len(w) for w in THAI_LABELS if i - len(w) >= start and t.startswith(w, i - len(w))]
    return min(found, default=None)


def _thai_space(t: str, i: int, j: int, start: int) -> bool:
    """Whether the blank t[i:j] ends a sentence of a script that is written without blanks between words."""
    if i <= start or j >= len(t):
        return False
    p, f = t[i - 1], t[j]
    p_thai, f_thai = _THAI.match(p) is not None, _THAI.match(f) is not None
    if p_thai and f_thai:
        return THAI_LEADS_IN.search(t, max(start, i - _LEADS_IN), i) is None and THAI_GOES_ON.match(t, j) is None
    if p_thai and f in "“‘\"'(":
        return False
    if f_thai and (p.isdigit() or "๐" <= p <= "๙"):
        label = _thai_label(t, start, i)
        return label is not None and label > start and THAI_GOES_ON.match(t, j) is None
    if f_thai and (p in _CLOSERS or p in "\"'"):
        return THAI_GOES_ON.match(t, j) is None
    return False


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of all sentence units of a text."""
    if not text or text.isspace():
        return []
    t = text.replace("\r\n", " \n").replace("\r", "\n") if "\r" in text else text
    out: list[tuple[int, int]] = []
    at, n = 0, len(t)
    bounds = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(t)] + [(n, n)]
    for a, b in bounds:
        out.extend(_block(t, at, a))
        at = b
    return out


def _block(t: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Units of a block between blank lines: list items by line, else the sentences of a paragraph."""
    while lo < hi and t[lo] == "\n":
        lo += 1
    if lo >= hi or t[lo:hi].isspace():
        return
    first = _MARKER.match(t, lo, hi)
    if first is None:
        lines = t[lo:hi].split("\n")
        if len(lines) > 1:
            # an introduction that runs into a list without a blank line
            at = lo
            for k, line in enumerate(lines):
                m = _MARKER.match(line)
                if k and m and m.lastgroup == "dot" and _numbered(lines[k:]) or k and m and m.lastgroup != "dot" and (k + 1 == len(lines) or (x := _MARKER.match(lines[k + 1])) and x.lastgroup == m.lastgroup):
                    yield from _paragraph(t, lo, at - 1)
                    yield from _block(t, at, hi)
                    return
                at += len(line) + 1
        elif _THAI.search(lines[0]) and _thai_label(t, lo, hi) == lo:
            yield (lo, lo + len(lines[0].rstrip()))
            return
        yield from _paragraph(t, lo, hi)
        return
    start, at, levels = lo, lo, [(first.lastgroup, _indent(t, lo))]
    while at < hi:
        e = t.find("\n", at, hi)
        nxt = hi if e < 0 else e + 1
        m = _MARKER.match(t, at, hi)
        if at > lo and m is not None and _level(levels, m.lastgroup, _indent(t, at), m.group().strip()):
            yield from _trimmed(t, start, at)
            start = at
        at = nxt
    yield from _trimmed(t, start, hi)


def _indent(t: str, at: int) -> int:
    n = at
    while n < len(t) and t[n].isspace() and t[n] != "\n":
        n += 1
    return n - at


#: Markers a list begins with.
_FIRST = re.compile(r"\(?(?:1|가|[Aa])[.)]+|[①❶㉠ⓐ⑴]")


def _level(levels: list[tuple[str, int]], kind: str, indent: int, marker: str) -> bool:
    """Whether a marker begins an item: one of an open level (the levels below it are popped), or the first of a deeper or new level, which is pushed."""
    for k in range(len(levels) - 1, -1, -1):
        if levels[k][0] == kind and (levels[k][1] <= indent or k == 0):
            if levels[k][1] < indent and k == len(levels) - 1 and (kind == "bullet" or _FIRST.fullmatch(marker)):
                levels.append((kind, indent))
            else:
                del levels[k + 1 :]
            return True
    if kind == "bullet" or indent > levels[-1][1] or _FIRST.fullmatch(marker):
        levels.append((kind, indent))
        return True
    return False


def _numbered(lines: list[str]) -> bool:
    """Whether lines begin with item 1 and go on to item 2; a lone number at a line end may be part of a date."""
    numbers = [int(m["dot"][:-1]) for m in map(_MARKER.match, lines) if m and m.lastgroup == "dot"]
    return numbers[:2] == [1, 2]


def _trimmed(t: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while a < b and t[a].isspace():
        a += 1
    while b > a and t[b - 1].isspace():
        b -= 1
    if a < b:
        yield (a, b)


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char), one row per unit; one narrow pass over the texts, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, starts, ends = [], [], []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                for a, b in units(text):
                    ids.append(d)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "start_char": pd.Series(starts, dtype="int64"), "end_char": pd.Series(ends, dtype="int64")})

    narrow = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")).where("text is not null and doc_id is not null")
    return narrow.mapInPandas(run, "doc_id long, start_char long, end_char long")
