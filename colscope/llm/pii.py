"""Personal data: exact identifiers, and disguised ones found in a normalised text and mapped back to the source.

Two transducers run one after the other. The first writes look-alike characters as the plain ones they
imitate and takes out invisible ones; the second, an automaton over words, writes spelled digits as
digits and disguises of @ and . as these. Each keeps which source characters an output stands for, so
that spans found in the last text lead back to the first.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, utf8

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base. The local part of an email is read backwards from its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, PART_MOST = (14, 19), (10, 15), 255

# Letters of other scripts that look like Latin ones, dots and dashes; the rest follows
# from Unicode's own compatibility forms and decimal digits.
LOOK_ALIKES = {
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іɩι", "j": "јϳ", "k": "κ", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", ".": "。｡", "-": "‐‑‒–—−",
}
INVISIBLE = re.compile("[­​-‍⁠﻿]")

# Words, parameters of the second transducer: digits from 0 to 9 of some languages, and names of signs.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
SIGN_WORDS = {"@": ("at", "arroba", "arobase"), ".": ("dot", "punkt", "punto", "point"), "+": ("plus",)}
BRACKETS = ("[]", "()", "{}", "<>")
# So many spelled digits in a row at least are a number and not prose.
LEAST_SPELLED = 3
# An "at" without brackets counts only before a disguised dot and with one of these at the end.
ENDINGS = frozenset("com org net edu gov mil int info biz io ai co me tv dev app uk eu de at ch fr es it nl be pt pl ru se no dk fi ie us ca au nz jp cn in br mx ar".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= PART_MOST


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(begin, number of the kind, end) of the base, in order. Linear in the text, whatever it holds."""
    found = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < m.start():
                found.append((begin, 0, m.end()))
                last = m.end()
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = digits_of(m.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(digits_of(m.group())) <= PHONE_DIGITS[1]]
    return sorted(found)


class Aligned:
    """A rewritten text that knows which source characters each of its own stands for."""

    def __init__(self, source: str, edits: Iterable[tuple[int, int, str]]):
        self.begins, self.ends, self.sources = [], [], []
        pieces, at, size = [], 0, 0
        for begin, end, out in edits:
            pieces += [source[at:begin], out]
            size += begin - at
            self.begins.append(size)
            size += len(out)
            self.ends.append(size)
            self.sources.append((begin, end))
            at = end
        self.text = "".join([*pieces, source[at:]])

    def span(self, begin: int, end: int) -> tuple[int, int]:
        """The source characters that the characters from ``begin`` to ``end`` stand for."""
        return self._place(begin)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        i = bisect_right(self.ends, at)
        if i < len(self.begins) and self.begins[i] <= at:
            return self.sources[i]
        moved = at + (self.sources[i - 1][1] - self.ends[i - 1] if i else 0)
        return moved, moved + 1


@cache
def plain_characters() -> dict[int, str]:
    """Look-alike characters and the plain ones they stand for, one for one."""
    table = {ord(c): plain for plain, others in LOOK_ALIKES.items() for c in others}
    for code in range(0xA0, 0x20000):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and " " <= plain <= "~":
            table.setdefault(code, plain)
        elif (digit := unicodedata.decimal(c, None)) is not None:
            table.setdefault(code, str(digit))
    return table


@cache
def look_alikes() -> frozenset[str]:
    return frozenset(map(chr, plain_characters()))


def unmask(text: str) -> Aligned:
    """The first transducer: look-alikes one for one, invisible characters to nothing."""
    if text.isascii():
        return Aligned(text, ())
    seen = text if look_alikes().isdisjoint(text) else text.translate(plain_characters())
    return Aligned(seen, ((m.start(), m.end(), "") for m in INVISIBLE.finditer(text)))


LABELS, BLANKS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"), re.compile(" *")


class Spelled:
    """The second transducer: an automaton of words and signs, and the contexts in which they are rewritten."""

    def __init__(self):
        self.machine = ahocorasick.Automaton()
        for words in DIGIT_WORDS:
            for digit, word in enumerate(words.split()):
                self.machine.add_word(word, (len(word), "digit", str(digit)))
        for sign, words in SIGN_WORDS.items():
            for word in words:
                self.machine.add_word(word, (len(word), "word", sign))
                for a, b in BRACKETS if sign != "+" else ():
                    for pad in ("", " "):
                        self.machine.add_word(f"{a}{pad}{word}{pad}{b}", (len(word) + 2 + 2 * len(pad), "bracket", sign))
        for sign in "@.":
            for a, b in BRACKETS:
                self.machine.add_word(f"{a}{sign}{b}", (3, "bracket", sign))
        self.machine.make_automaton()

    def tokens(self, text: str) -> list[tuple[int, int, str, str]]:
        """(begin, end, kind, output) of the words that stand alone and of the signs in brackets."""
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found = []
        for last, (size, kind, out) in self.machine.iter_long(lower):
            begin, end = last + 1 - size, last + 1
            if kind == "bracket" or not (begin and lower[begin - 1].isalnum() or end < len(lower) and lower[end].isalnum()):
                found.append((begin, end, kind, out))
        return found

    def run(self, text: str) -> Aligned:
        tokens = self.tokens(text)
        return Aligned(text, sorted([*self.numbers(text, tokens), *self.signs(text, tokens)]) if tokens else ())

    def numbers(self, text, tokens):
        """Spelled digits in rows of ``LEAST_SPELLED`` or more; a row goes on over one blank or dash, and over dots."""
        row: list = []
        for token in [*tokens, None]:
            near = token and row and (text[row[-1][1] : token[0]] in (" ", "-", "") or "." in (token[3], row[-1][3]) and not text[row[-1][1] : token[0]].strip(" "))
            if token and (token[2] == "digit" or token[3] == ".") and (near or not row):
                row.append(token)
                continue
            if sum(t[2] == "digit" for t in row) >= LEAST_SPELLED:
                for t, after in zip(row, [*row[1:], None]):
                    if t[2] == "digit":
                        # a separator between two digits goes with the first
                        yield t[0], after[0] if after and after[2] == "digit" else t[1], t[3]
            row = [token] if token and (token[2] == "digit" or token[3] == ".") else []

    def signs(self, text, tokens):
        """Disguises of signs with the blanks around them, where letters or digits stand on both sides."""
        last = 0
        for i, (begin, end, kind, out) in enumerate(tokens):
            if kind == "digit":
                continue
            a, b = begin, end
            while a > last and text[a - 1] == " ":
                a -= 1
            while b < len(text) and text[b] == " ":
                b += 1
            if out == "+":
                spelled = i + 1 < len(tokens) and tokens[i + 1][:1] == (b,) and tokens[i + 1][2] == "digit"
                if b < len(text) and (text[b].isdigit() or spelled):
                    last = b
                    yield begin, b, "+"
                continue
            if a == 0 or b == len(text) or not (text[a - 1] in LOCAL and text[b].isalnum()) or kind == "word" and (a == begin or b == end):
                continue
            if kind == "word" and out == "@" and not self.before_dots(text, tokens, i, b):
                continue
            last = b
            yield a, b, out

    @staticmethod
    def before_dots(text, tokens, i, at) -> bool:
        """Whether after a bare "at" labels follow, apart by disguised dots or real ones, up to a known ending."""
        disguised = 0
        for j in range(i + 1, len(tokens)):
            begin, end, _, out = tokens[j]
            label = LABELS.match(text, at)
            if out != "." or not label or BLANKS.match(text, label.end()).end() != begin:
                break
            disguised += 1
            at = BLANKS.match(text, end).end()
        rest = LABELS.match(text, at)
        return bool(disguised and rest and rest.group().lower().split(".")[-1] in ENDINGS)


class Finder:
    def __init__(self):
        self.spelled = Spelled()

    def find(self, text: str) -> tuple[list, list]:
        """The base, and all spans: (begin, number of the kind, end) of the source each, in order.

        A span that was disguised counts where it meets none of the base of its kind; an email also
        where it holds a whole one and more.
        """
        base = identifiers(text)
        first = unmask(text)
        second = self.spelled.run(first.text)
        if second.text == text:
            return base, base
        found = set(base)
        of_kind = [[(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))]
        for begin, kind, end in identifiers(second.text):
            a, b = first.span(*second.span(begin, end))
            if text[a:b] != second.text[begin:end]:
                met = near(of_kind[kind], a, b)
                if not met or kind == 0 and all(a <= x and y <= b for x, y in met) and (a, b) not in met:
                    found.add((a, kind, b))
        return base, sorted(found)


def near(spans: list[tuple[int, int]], begin: int, end: int) -> list[tuple[int, int]]:
    """Those of the ordered, disjoint spans that share a character with begin to end."""
    met = []
    for i in range(bisect_right(spans, (begin,)) - 1, len(spans)):
        if i >= 0 and spans[i][0] >= end:
            break
        if i >= 0 and spans[i][1] > begin:
            met.append(spans[i])
    return met


SPANS = "array<struct<kind: string, begin: bigint, end: bigint>>"


def find_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row, both by begin, then kind; code points, end exclusive.

    ``base`` are identifiers as they stand, ``spans`` also those found behind look-alike characters,
    spelled digits and disguised signs. Null and empty texts have none; null doc_ids and repeated
    rows are kept, other columns are not looked at, no rows give no rows.
    """

    def step():
        finder = Finder()
        named = lambda spans: [{"kind": KINDS[k], "begin": a, "end": b} for a, k, b in spans]

        def work(part):
            found = [finder.find(t.decode()) for t in part["text"]]
            return {"doc_id": part["doc_id"], "base": [named(x) for x, _ in found], "spans": [named(x) for _, x in found]}

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    return in_batches(documents.select("doc_id", utf8()), f"doc_id {kind}, base {SPANS}, spans {SPANS}", step, "text")


def personal_data_digest(found: DataFrame) -> DataFrame:
    """Counts of the base by kind, its hash, and all spans as one text."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")

    counts = [F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
