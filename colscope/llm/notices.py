"""License scan: exact places of phrases, and short notices found with bounded errors.

A notice that may have k errors is split into k + 1 pieces, one of which a match must hold unchanged.
The pieces lead to the candidates; the fuzzy matching of the regex library decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, utf8

# Phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices looked for with errors, a parameter: text of words and one blank between them, and label.
NOTICES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge", "mit"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("all rights reserved", "reserved"),
)
# One error for each so many characters of a notice, and one at least.
CHARS_PER_ERROR = 12

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def errors_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_ERROR)


def pieces(notice: str) -> list[tuple[str, int]]:
    """The notice cut into one piece more than it may have errors: (piece, where it starts)."""
    n = errors_of(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Match:
    label: str
    first_word: int
    last_word: int
    edits: int
    similarity: float


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches of one notice, the ones with fewer errors first, without those that overlap one taken before."""
    begins: list[int] = []
    taken: list[tuple[int, int, int, int]] = []
    for match in sorted(found, key=lambda m: (m[2], m[0])):
        i = bisect_left(begins, match[0])
        if (i and taken[i - 1][1] > match[0]) or (i < len(taken) and begins[i] < match[1]):
            continue
        begins.insert(i, match[0])
        taken.insert(i, match)
    return taken


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE):
        self.notices, self.base = notices, base
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(notices):
            for piece, start in pieces(notice):
                at.setdefault(piece, []).append((k, start))
        for piece, where in at.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        # whole words only; by the number of errors allowed
        self.fuzzy = [self.pattern(n, errors_of(n)) for n, _ in notices]
        self.exactly = [[self.pattern(n, e) for e in range(errors_of(n) + 1)] for n, _ in notices]

    @staticmethod
    def pattern(notice: str, errors: int) -> regex.Pattern:
        """Whole words within so many errors. An error cannot be a character in front: that makes another word."""
        first, rest = (regex.escape(x, literal_spaces=True) for x in (notice[0], notice[1:]))
        ways = [f"{first}(?:{rest}){{e<={errors}}}"]
        if errors:
            # the first character replaced, or left out
            ways += [f"[^ ](?:{rest}){{e<={errors - 1}}}", f"(?:{rest}){{e<={errors - 1}}}"]
        return regex.compile(f"(?<![^ ])(?:{'|'.join(ways)})(?![^ ])")

    def base_places(self, joined: str) -> list[tuple[int, str]]:
        """(word, label) of every place where a phrase's words stand one after the other."""
        found = []
        for phrase, label in self.base.items():
            at = joined.find(f" {phrase} ")
            while at >= 0:
                found.append((at, label))
                at = joined.find(f" {phrase} ", at + 1)
        return found

    def matches(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) of the fuzzy matches; those of one notice don't overlap.

        Every word that a seed lets a notice begin with is tried. Where matches of a notice overlap,
        fewer errors go first, then the earlier start.
        """
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.seeds.iter(joined):
            for k, start in where:
                slack = errors_of(self.notices[k][0])
                at = end + 1 - size - start
                # a word begins after a blank
                begin = joined.find(" ", max(0, at - slack - 1), max(0, at + slack))
                while begin >= 0:
                    starts.setdefault(k, set()).add(begin + 1)
                    begin = joined.find(" ", begin + 1, max(0, at + slack))
        found = []
        for k, places in starts.items():
            tried = [m for m in (self.match_at(joined, k, at) for at in sorted(places)) if m]
            found += apart(tried)
        return self.best(sorted(found))

    def match_at(self, joined: str, k: int, start: int) -> tuple[int, int, int, int] | None:
        """The match of a notice that begins here: with the fewest errors, of those the shortest."""
        size, most = len(self.notices[k][0]), errors_of(self.notices[k][0])
        best = None
        end = joined.find(" ", max(start + 1, start + size - most), start + size + most + 1)
        while end >= 0:
            # the end is given, since a search for it can pass over matches that leave out last characters
            if self.fuzzy[k].fullmatch(joined, start, end):
                errors = next(e for e, pattern in enumerate(self.exactly[k]) if pattern.fullmatch(joined, start, end))
                if best is None or errors < best[2]:
                    best = (start, end, errors, k)
            end = joined.find(" ", end + 1, start + size + most + 1)
        return best

    def best(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without the matches that overlap one of another label with fewer errors."""
        reach = max((end - start for start, end, _, _ in found), default=0)
        starts, kept = [m[0] for m in found], []
        for start, end, edits, k in found:
            near = found[bisect_left(starts, start - reach) : bisect_left(starts, end)]
            if not any(e < edits and start < b and self.notices[j][1] != self.notices[k][1] for _, b, e, j in near):
                kept.append((start, end, edits, k))
        return kept

    def scan(self, text: bytes) -> dict:
        words = WORDS.findall(text.lower())
        joined = " " + b" ".join(words).decode() + " "
        base = self.base_places(joined)
        fuzzy, matches = self.matches(joined), []
        blanks = [i for i, c in enumerate(joined) if c == " "] if base or fuzzy else []
        for start, end, edits, k in fuzzy:
            notice, label = self.notices[k]
            span = joined[start:end]
            before = start + len(span) - len(span.lstrip(" "))
            first = bisect_left(blanks, before) - 1
            matches.append(Match(label, first, first + len(span.split()) - 1, edits, max(0.0, 1 - edits / len(notice))))
        starts = sorted(bisect_left(blanks, at) for at, _ in base)
        base_labels = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": starts[0] if starts else None,
            "last_word": starts[-1] if starts else None,
            "base_labels": sorted(base_labels),
            "labels": sorted(base_labels | {m.label for m in matches}),
            "score": 1.0 if base else max((m.similarity for m in matches), default=0.0),
            "matches": [{"label": m.label, "first_word": m.first_word, "last_word": m.last_word, "edits": m.edits} for m in matches],
        }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, matches array<struct<label: string, first_word: long, last_word: long, edits: int>>"


def scan_licenses(documents: DataFrame, notices=NOTICES, base=BASE) -> DataFrame:
    """Per row: doc_id, n_words, the base places and labels, all labels, a score, and the fuzzy matches with spans.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered. The
    score is that of the best match: 1 for a phrase of the base, else the share of a notice's
    characters without errors. Spans are word numbers from 0; a notice that comes several times, with
    and without errors, has all its places.

    Null and empty texts have no words, no labels and score 0. Null doc_ids and repeated rows are
    kept; no rows give no rows; other columns are not looked at.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def step():
        scanner = Scanner(notices, base)

        def work(part):
            found = [scanner.scan(t) for t in part["text"]]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
            return {"doc_id": part["doc_id"], **{k: [x[k] for x in found] for k in names}}

        return work

    return in_batches(documents.select("doc_id", utf8()), f"doc_id {id_type}, {FIELDS}", step, "text")


def license_digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score", "matches",
    )
