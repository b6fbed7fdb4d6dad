"""Personal data with offset-preserving deobfuscation.

A transducer rewrites the text: homoglyphs and full-width forms become ASCII, invisible characters vanish,
spelled digits become digits, and at / dot / plus disguises become @, . and +. Every output character remembers
the source characters it stands for. Detectors for email, ip, card and phone run on the text as it is (the base
spans) and on the rewritten text; spans found there are mapped back to source characters and added unless they
touch a base span of their kind.

Defined results: a null text counts as empty and has no spans; rows repeat as they are; ids may be null; transducers
and detectors read very long texts whole, in linear time; an empty table gives an empty result; other columns are ignored.
Offsets are code points of the source text, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, documents

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain. A match holds one @, so looking at each @ in turn finds them in linear time."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """The base spans of a text: start, end, kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Letters of other scripts that look like ASCII ones, and the words that stand for digits and signs.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ҽ": "e", "һ": "h", "ӏ": "l", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l", "օ": "o", "ո": "n", "ս": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "⁺": "+",
    " ": " ", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = "­​‌‍⁠⁡⁢⁣⁤﻿᠎͏"
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT_WORDS = ("at", "arobase", "arroba", "klammeraffe", "ät")
_DOT_WORDS = ("dot", "punkt", "point", "punto", "period")
_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "us", "example", "dev", "ai")


def _folds() -> dict[str, str]:
    """Characters with a compatibility form of ASCII (full-width, mathematical, circled, superscript), by Unicode's own tables."""
    out = dict(_LOOKALIKES)
    ranges = ((0x00B2, 0x00BA), (0x2070, 0x209D), (0x2100, 0x2150), (0x2460, 0x2500), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))
    for a, b in ranges:
        for c in map(chr, range(a, b)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain < "\x7f" and c not in out:
                out[c] = plain
    return out


_FOLD = _folds()
_CHANGED = _FOLD | dict.fromkeys(_INVISIBLE, "")
_UNUSUAL = re.compile("[^" + "".join(c for c in map(chr, range(256)) if c not in _CHANGED and c not in "]\\^-") + "\\]\\\\^-]")  # outside Latin-1, or changed within it
_number = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_number}|[0-9]+)(?:[ ,.()-]{{1,3}}(?:{_number}|[0-9]+)(?![^\W_]))+(?![^\W_])", re.I)
_NUMBER = re.compile(rf"{_number}|[0-9]", re.I)
_at, _dot = "|".join(_AT_WORDS), "|".join(_DOT_WORDS)
# Brackets take the white space around them; that before is added by code, since a pattern would try each place of a run.
_BRACKET_AT = re.compile(rf"[\[({{<][ \t]*(?:{_at}|@)[ \t]*[\])}}>][ \t]*", re.I)
_BRACKET_DOT = re.compile(rf"[\[({{<][ \t]*(?:{_dot}|\.)[ \t]*[\])}}>][ \t]*", re.I)
_AT_SIGN = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:[ \t]+({_at})[ \t]+|[ \t]*(@)[ \t]*)", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:[ \t]+(?:{_dot})[ \t]+|\.)[A-Za-z0-9-]+)*(?:[ \t]+(?:{_dot})[ \t]+|\.)(?:{'|'.join(_DOMAINS)})(?![A-Za-z0-9])", re.I)
_SPACED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?P<at>[ \t]*@[ \t]*)(?P<host>[A-Za-z0-9-]+(?:[ \t]?\.[ \t]?[A-Za-z0-9-]+)*[ \t]?\.[ \t]?(?:{'|'.join(_DOMAINS)}))(?![A-Za-z0-9])",
    re.I,
)
#: Which dot words go with which bare at words; others in between are prose.
_PAIRS = {"at": {"dot", "punkt"}, "ät": {"dot", "punkt"}, "klammeraffe": {"punkt"}, "arobase": {"point"}, "arroba": {"punto"}, "@": set(_DOT_WORDS)}
_SPOKEN_IP = re.compile(rf"(?<![^\W_])[0-9]{{1,3}}(?:(?:[ \t]+(?:{_dot})[ \t]+|\.)[0-9]{{1,3}}){{3}}(?![^\W_])", re.I)
_DOT_WORD = re.compile(rf"[ \t]+(?:{_dot})[ \t]+", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus[ \t]+(?=[0-9])", re.I)
_BRACKETS = re.compile(r"[\[({<][ \t]*(?:[^\W\d_]+|[@.])[ \t]*[\])}>]")  # no flag, so that the search can skip ahead
_ENDINGS = tuple(f".{d}" for d in _DOMAINS)
_DOT_SET = frozenset(_DOT_WORDS)
_AT_SET = frozenset(_AT_WORDS)
_DIGIT_SET = frozenset(_DIGIT_WORDS)
_ODD = frozenset(_CHANGED) | {"ſ", "İ"}  # these two equal s and i where case is ignored, but lower() does not make them so
_TOKEN = re.compile(r"[^\W_]+")


#: A number of so many digits, three different ones or more, that was at least half spelled is a phone number even without a plus.
_SPELLED_PHONE = range(10, 14)


class Rewritten:
    """A text with, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Edits (start, end, replacement) in order, apart from each other. Characters of a replacement stand for the whole stretch, or one each if lengths agree."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            text.append(new)
            if len(new) == b - a:
                starts += self.starts[a:b]
                ends += self.ends[a:b]
            else:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Rewritten("".join(text), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def suspicious(text: str) -> bool:
    """Whether some transducer may have work to do: true wherever one of them would edit the text as it is; a false alarm costs time only."""
    if not text.isascii() and _UNUSUAL.search(text) is not None and not _ODD.isdisjoint(text):
        return True
    if " @" in text or "@ " in text or "\t@" in text or "@\t" in text or _BRACKETS.search(text) is not None:
        return True
    if "@" in text and any(d["host"].count(" ") + d["host"].count("\t") for d in _SPACED.finditer(text)):
        return True
    low = text.lower()
    words = _TOKEN.findall(low)
    seen = set(words)
    if "plus" in seen or not _DOT_SET.isdisjoint(seen):
        return True
    if not _AT_SET.isdisjoint(seen) and any(e in low for e in _ENDINGS):
        return True
    if not _DIGIT_SET.isdisjoint(seen):
        spelled = number = False  # of the word before
        for w in words:
            word = w in _DIGIT_SET
            if word and number or spelled and (word or w.isdigit()):
                return True
            spelled, number = word, word or w.isdigit()
    return False


def _with_space_before(text: str, pattern: re.Pattern, new: str) -> list[tuple[int, int, str]]:
    """An edit for each match, with the white space before it."""
    out, free = [], 0
    for m in pattern.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in " \t":
            start -= 1
        out.append((start, m.end(), new))
        free = m.end()
    return out


def _local_before(text: str, end: int, free: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the words before `end` begin that dot words join, back to `free` at most, and those dot words with the space around them."""

    def back(at: int, chars) -> int:
        while at > free and text[at - 1] in chars:
            at -= 1
        return at

    start, dots = back(end, _LOCAL), []
    while True:
        stop = back(start, " \t")
        word = back(stop, _LOCAL)
        if stop == start or text[word:stop].lower() not in _DOT_SET:
            return start, dots[::-1]
        before = back(word, " \t")
        more = back(before, _LOCAL)
        if before == word or more == before:
            return start, dots[::-1]
        dots.append((before, start))
        start = more


def spoken_addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn words and spaced signs of addresses into signs. Looking at each at in turn takes linear time:
    hosts are read forwards, and only if there is one the words before, as far as the last address."""
    edits: list[tuple[int, int, str]] = []
    at, free = _AT_SIGN.search(text), 0
    while at is not None:
        host = _HOST.match(text, at.end())
        if host is None:
            at = _AT_SIGN.search(text, at.start() + 1)
            continue
        start, dots = _local_before(text, at.start(), free)
        if start == at.start():  # what precedes belongs to the last address
            at = _AT_SIGN.search(text, at.start() + 1)
            continue
        after = [d.span() for d in _DOT_WORD.finditer(text, *host.span())]
        if {text[a:b].strip().lower() for a, b in dots + after} <= _PAIRS[(at[1] or at[2]).lower()]:
            edits += [(a, b, ".") for a, b in dots] + [(at.start(), at.end(), "@")] + [(a, b, ".") for a, b in after]
        free = host.end()
        at = _AT_SIGN.search(text, free)
    return [e for e in edits if e[2] != text[e[0] : e[1]]]


def deobfuscate(text: str) -> Rewritten:
    out = Rewritten(text)
    if not text.isascii():
        out = out.replace([(k, k + 1, _CHANGED[c]) for k, c in enumerate(text) if c in _CHANGED])
    spelled = [(m.start() + n.start(), m.start() + n.end(), _DIGIT_WORDS.get(n[0].lower(), n[0])) for m in _SPELLED.finditer(out.text) if sum(1 for _ in _NUMBER.finditer(m[0])) >= 4 and re.search("[^\\W\\d]", m[0]) for n in _NUMBER.finditer(m[0])]
    out = out.replace(spelled)
    out = out.replace(_with_space_before(out.text, _BRACKET_AT, "@"))
    out = out.replace(_with_space_before(out.text, _BRACKET_DOT, "."))
    out = out.replace(spoken_addresses(out.text))
    spaced = [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for m in _SPACED.finditer(out.text) for d in re.finditer(r"[ \t]+\.[ \t]*|\.[ \t]+", m["host"])]
    ats = [(m.start("at"), m.end("at"), "@") for m in _SPACED.finditer(out.text) if len(m["at"]) > 1]
    out = out.replace(sorted(spaced + ats))
    out = out.replace([(d.start(), d.end(), ".") for m in _SPOKEN_IP.finditer(out.text) for d in _DOT_WORD.finditer(out.text, m.start(), m.end())])
    return out.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])


def spelled_phones(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _SPELLED.finditer(text):
        digits = [n[0] for n in _NUMBER.finditer(m[0])]
        if len(digits) in _SPELLED_PHONE and 2 * sum(len(d) > 1 for d in digits) >= len(digits) and len({d.lower() for d in digits}) >= 3:
            out.append(m.span())
    return out


class _Taken:
    """Disjoint stretches of a text, to which later ones are added in order."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.last = 0  # end of the last one added
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """False if a to b touches what is taken. Calls come by ascending a."""
        k = bisect_left(self.starts, b) - 1
        if a < self.last or k >= 0 and self.ends[k] > a:
            return False
        self.last = b
        return True


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind as listed."""
    text = text or ""
    base = detect(text)
    every = list(base)
    if suspicious(text):
        clean = deobfuscate(text)
        if clean.text != text:
            taken = {kind: _Taken((a, b) for a, b, k in base if k == kind) for kind in KINDS}
            for a, b, kind in detect(clean.text):
                span = clean.source(a, b)
                if taken[kind].add(*span):
                    every.append((*span, kind))
            anything = _Taken((a, b) for a, b, _ in every)
            every += [(a, b, "phone") for a, b in spelled_phones(text) if anything.add(a, b)]
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s[0], rank[s[2]])
    return sorted(base, key=order), sorted(every, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans, how many the rewriting added, and how many there are."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base, every = find(text)
            counts = [sum(s[2] == k for s in base) for k in KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every)))
        kinds = [x.split() for x in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scan, _OUT)


def masked(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with every span replaced by its kind."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find(text)[1]:
        if a >= at:
            out += [text[at:a], mark.format(kind.upper())]
            at = b
    return "".join([*out, text[at:]])


def op2(spark, sf_dir):
    return personal_data(documents(spark, sf_dir))
