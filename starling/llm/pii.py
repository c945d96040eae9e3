"""Personal data in whole texts, also where it is disguised, with offsets into the source.

Base spans come from plain patterns on the source. Disguised identifiers are
found on a normalised copy: transducers replace look-alike characters, drop
invisible ones, and rewrite spelled digits and at/dot disguises; each normalised
character keeps the source span it came from, so a match maps back exactly.
Only texts with a trace of a disguise are normalised, whole. Parts of a disguised
address are as long as addresses allow (64 and 63 characters, nine parts), and
words of it lie at most eight blanks apart.

Defined results: a null text is empty and has no spans; repeated rows give the
same result each; offsets are code points, end exclusive; a disguised span that
lies inside a base span of its kind is not added; a text of any length is read
whole, in time proportional to it; an empty table gives no rows; other columns,
whatever their names, are ignored by ``scan`` and kept by ``redact``, which
leaves null texts null.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Possessive runs and the look-behind only avoid repeated scans; a match always begins at the first digit of a run.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return (sum(map(int, odd[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in odd[1::2])) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ with the longest local part before it (not into the match before) and a dotted domain after."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done:
            head = text[done:at]
            start = done + len(head.rstrip(LOCAL))
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                done = m.end()
            else:
                done = at + 1  # no local part reaches over an @
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m.group())) <= 15]
    return sorted(out)


#: Letters of other scripts that look like Latin ones, pair by pair.
LOOK_ALIKE = dict(zip(
    "аеорсухіјѕԁһԛԝӏгАВЕКМНОРСТУХІЈЅαενορτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhqwlrABEKMHOPCTYXIJSaevoptuikABEZHIKMNOPTYX",
    strict=True,
))
#: Characters without width or shape of their own.
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Dashes, dots, at signs and plus signs of other blocks.
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "•": ".", "＠": "@", "﹫": "@", "＋": "+", "⁺": "+", " ": " ", " ": " ", " ": " ", "　": " "}
#: Number words by language, from nought to nine.
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
NUMBERS = {w: str(i) for words in NUMBER_WORDS.values() for i, w in enumerate(words.split())} | {"oh": "0", "zwo": "2", "fuenf": "5", "cinco": "5"}
SPELLED = "|".join(sorted(map(re.escape, NUMBERS), key=len, reverse=True))
#: The patterns of disguises are linear in the text: parts have the lengths that identifiers can have, gaps are short, and a run of blanks is only looked at from its beginning.
GAP = r"[\x20-]{1,3}"
#: A run of at least three number words, maybe with digits, groups and a plus between.
SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus{GAP}|\+[\x20]?)?(?:(?:(?:double|triple){GAP})?(?:{SPELLED}|[0-9]++)(?!\w)[\x20,.()-]{{0,3}}){{3,}}")
SPELLED_WORD = re.compile(rf"(?i)(?:(double|triple){GAP})?(?<!\w)({SPELLED}|[0-9]++)(?!\w)|(plus)(?=[\x20-])")
WORD_OF_NUMBER = re.compile(rf"(?i)(?<!\w)(?:{SPELLED})(?!\w)")
#: Four groups of one to three digits or number words.
GROUP = rf"(?:{SPELLED}|[0-9]{{1,3}}+)(?:{GAP}(?:{SPELLED}|[0-9]{{1,3}}+)){{0,2}}"
DOT_WORD = r"\x20{1,8}(?:dot|punkt|point|punto)\x20{1,8}"
DOTTED_WORDS = re.compile(rf"(?i)(?<!\w){GROUP}(?:{DOT_WORD}{GROUP}){{3}}(?!\w)")
BLANKS = r"(?:(?<!\x20)\x20*+)?"
AT_SIGN = re.compile(rf"(?i){BLANKS}[\[({{<]{{1,2}}\x20*+(?:at|@|ät|arobase|arroba)\x20*+[\])}}>]{{1,2}}\x20*+|(?<!\x20)\x20++(?:arobase|arroba|klammeraffe)\x20++|&#0{{0,8}}64;|&#x0{{0,8}}40;|&commat;|%40|(?<=\w)\x20++@\x20*+(?=\w)|(?<=\w)@\x20++(?=\w)")
DOT_SIGN = re.compile(rf"(?i){BLANKS}[\[({{<]{{1,2}}\x20*+(?:dot|\.|punkt|point|punto)\x20*+[\])}}>]{{1,2}}\x20*+|&#0{{0,8}}46;|&#x0{{0,8}}2e;|&period;")
#: Plain words stand for signs only where the whole reads as an address: name at domain dot ending.
DOT = rf"(?:{DOT_WORD}|\.)"
PLAIN_AT = re.compile(rf"(?i)(?<![\w.%+-])[a-z0-9_%+-]{{1,64}}(?:{DOT}[a-z0-9_%+-]{{1,64}}){{0,8}}(?:\x20{{1,8}}at\x20{{1,8}}|@)[a-z0-9-]{{1,63}}(?:{DOT}[a-z0-9-]{{1,63}}){{0,8}}{DOT}[a-z]{{2,24}}(?!\w)")
PLAIN_SIGN = re.compile(r"(?i)[\x20]+(at|dot|punkt|point|punto)[\x20]+")
#: Parts of the patterns above: a match of AT_SIGN or DOT_SIGN has one of these (or BRACKETED), an edit by PLAIN_SIGN one of the words.
SIGN_PARTS = (" @", "@ ", "&#", "&commat;", "&period;", "%40", "arobase", "arroba", "klammeraffe")
BRACKETED = re.compile(r"[\[({<][\x20]*(?:at|@|ät|arobase|arroba|dot|\.|punkt|point|punto)[\x20]*[\])}>]")
DOT_WORDS = (" dot ", " punkt ", " point ", " punto ")
AT_PART = re.compile(r" at +[a-z0-9-]+(?:\.[a-z0-9-]| +(?:dot|punkt|point|punto) )")
WORD = re.compile(r"\w+")


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, at: list[tuple[int, int]] | None = None):
        self.text, self.at = text, at or [(i, i + 1) for i in range(len(text))]
        self.touched: set[int] = set()  # source offsets whose characters were rewritten

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string, for ordered, disjoint edits; each new character stands for the whole replaced source span."""
        if not edits:
            return
        text, at, done = [], [], 0
        for a, b, new in edits:
            if new == self.text[a:b]:
                continue
            text.append(self.text[done:a])
            at += self.at[done:a]
            text.append(new)
            if a < b:
                span = (self.at[a][0], self.at[b - 1][1])
                at += [span] * len(new)
                self.touched.update(range(*span))
            done = b
        text.append(self.text[done:])
        at += self.at[done:]
        self.text, self.at = "".join(text), at

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.at[a][0], self.at[b - 1][1]


def plain_form(c: str) -> str | None:
    """What a look-alike character stands for; None if it stays."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if c in SIGNS:
        return SIGNS[c]
    new = unicodedata.normalize("NFKC", c)
    if new != c and new.isascii() and new.strip():
        return new
    digit = unicodedata.digit(c, None)
    return None if digit is None else str(digit)


#: Every character that plain_form rewrites, and the two that patterns without case take for an i.
FOREIGN = frozenset(c for c in map(chr, range(0x80, 0x20000)) if c in "ıİ" or plain_form(c) is not None)


def look_alikes(m: Mapped) -> None:
    """Letters of a word are rewritten if all its letters then are ASCII, so that words of other scripts mostly stay."""
    if FOREIGN.isdisjoint(m.text):
        return
    edits = []
    for i, c in enumerate(m.text):
        if not c.isascii() and (new := plain_form(c)) is not None:
            edits.append((i, i + 1, new))
    m.rewrite(edits)


def spelled_digits(m: Mapped) -> None:
    edits = []
    for run in SPELLED_RUN.finditer(m.text):
        words = WORD_OF_NUMBER.findall(run.group())
        if (kinds := len({w.lower() for w in words})) < 2 or kinds < 3 and len(words) < 12:
            continue
        done, new = run.start(), []
        last = run.start()
        for w in SPELLED_WORD.finditer(m.text, run.start(), run.end()):
            if w.group(3):
                digits = "+"
            else:
                digits = NUMBERS.get(w.group(2).lower(), w.group(2)) * {"double": 2, "triple": 3}.get((w.group(1) or "").lower(), 1)
            if digits != "+" and new and new[-1][2] != "+" and m.text[last : w.start()].strip(" ,.-") == "":
                new.append((last, w.end(), digits))  # the blank between two digits goes
            else:
                new.append((w.start() if not (new and new[-1][2] == "+") else last, w.end(), digits))
            last = w.end()
        edits += [e for e in new if e[0] >= done]
    m.rewrite(edits)


def at_and_dot(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), "@") for x in AT_SIGN.finditer(m.text)])
    m.rewrite([(x.start(), x.end(), ".") for x in DOT_SIGN.finditer(m.text)])
    edits = []
    for x in PLAIN_AT.finditer(m.text):
        if (signs := [s for s in PLAIN_SIGN.finditer(x.group())]) and sum(s.group(1).lower() == "at" for s in signs) + x.group().count("@") == 1:
            edits += [(x.start() + s.start(), x.start() + s.end(), "@" if s.group(1).lower() == "at" else ".") for s in signs]
    m.rewrite(edits)
    edits = []
    for x in DOTTED_WORDS.finditer(m.text):
        edits += [(x.start() + s.start(), x.start() + s.end(), ".") for s in PLAIN_SIGN.finditer(x.group()) if s.group(1).lower() != "at"]
    m.rewrite(edits)


def spelled_addresses(m: Mapped) -> None:
    """Four dotted groups of number words: their words become digits before the dots are looked at."""
    edits = []
    for x in DOTTED_WORDS.finditer(m.text):
        last = None
        for w in SPELLED_WORD.finditer(m.text, x.start(), x.end()):
            digits = NUMBERS.get((w.group(2) or "").lower(), w.group(2) or "")
            joined = last is not None and m.text[last : w.start()].strip(" -") == ""
            edits.append((last if joined else w.start(), w.end(), digits))
            last = w.end()
    m.rewrite(edits)


def traces(text: str) -> bool:
    """Whether a transducer may change the text: as the first that does sees the source, each pattern is tried on it, behind parts that its matches must have."""
    if not text.isascii() and not FOREIGN.isdisjoint(text):
        return True
    low = text.lower()
    if (any(t in low for t in SIGN_PARTS) or BRACKETED.search(low)) and (AT_SIGN.search(text) or DOT_SIGN.search(text)):
        return True
    dots = sum(low.count(t) for t in DOT_WORDS)
    if (dots and "@" in low or AT_PART.search(low)) and PLAIN_AT.search(text) or dots >= 3 and DOTTED_WORDS.search(text):
        return True
    words = [w for w in WORD.findall(low) if w in NUMBERS]
    kinds = len(set(words))
    return (kinds >= 3 or kinds == 2 and len(words) >= 12) and SPELLED_RUN.search(text) is not None


def disguised_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the source that read as identifiers only after normalisation."""
    if not traces(text):
        return []
    m = Mapped(text)
    look_alikes(m)
    spelled_addresses(m)
    spelled_digits(m)
    at_and_dot(m)
    if not m.touched:
        return []
    found = base_spans(m.text)
    if any(c in m.text for c in "0123456789"):
        # A number that was spelled out needs no plus sign.
        for x in CARD.finditer(m.text):
            digits, (a, b) = only_digits(x.group()), m.source(x.start(), x.end())
            if 10 <= len(digits) <= 15 and not luhn_card(digits) and len(WORD_OF_NUMBER.findall(text[a:b])) >= 7:
                found.append((x.start(), 3, x.end()))
    own: list[list[tuple[int, int]]] = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    out = []
    for start, kind, end in found:
        a, b = m.source(start, end)
        near = bisect_right(own[kind], (a, len(text) + 1)) - 1  # base spans of a kind do not overlap: the last that begins at or before a
        if not m.touched.isdisjoint(range(a, b)) and not (near >= 0 and b <= own[kind][near][1]):
            out.append((a, kind, b))
    # Of spans of one kind that lie in one another, the longest.
    kept, reach = [], [-1] * len(KINDS)
    for a, kind, b in sorted(out, key=lambda x: (x[0], -x[2], x[1])):
        if b > reach[kind]:
            kept.append((a, kind, b))
            reach[kind] = b
    return sorted(kept)


def luhn_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, kind, end)."""
    base = base_spans(text or "")
    return base, sorted([*base, *disguised_spans(text or "", base)])


SCAN = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_disguised", pa.int64())])
SCAN_SQL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind (counts, digest), all spans, and how many of these were disguised."""

    def scanned(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in SCAN]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, all_spans = find(text)
                kinds = [k for _, k, _ in base]
                for to, x in zip(rows, (doc, *(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans), len(all_spans) - len(base)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, SCAN.types, strict=True)], schema=SCAN)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scanned, SCAN_SQL)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in brackets."""
    out, done = [], 0
    for a, k, b in spans:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the personal data in text_col replaced; all columns stay, length_col (if any) is counted anew."""
    names = docs.columns
    at = names.index(text_col)
    size = names.index(length_col) if length_col in names else None

    def changed(batches):
        for batch in batches:
            new = [None if t is None else redacted(t, find(t)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_map(docs, changed, docs.schema)
