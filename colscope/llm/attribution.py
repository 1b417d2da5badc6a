"""Token counts per section: whole documents are encoded once, and token spans are joined to section spans."""

from __future__ import annotations

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import kind, load_ranks
from .common import in_batches

# Rules for a token that lies in several sections: to the one with its first character, with its
# last, or with most of its characters (of equals, the earlier).
RULES = ("first", "last", "most")


def line_sections(documents: DataFrame) -> DataFrame:
    """The documents with ``sizes``: the code points of each line and the break that ends it."""
    text = F.coalesce("text", F.lit(""))
    sizes = F.transform(F.split(text, "\n", -1), lambda line: F.char_length(line).cast("long") + 1)
    return documents.select("doc_id", text.alias("text"), sizes.alias("sizes"))


def token_spans(ids: np.ndarray, sizes: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code point spans of tokens: a token that cuts a character spans the whole character."""
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    first_byte = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    point = np.cumsum(first_byte) - 1
    return point[starts], point[ends - 1] + 1


def check(sections: list) -> None:
    """Refuses sections that are not disjoint, sorted spans."""
    last = 0
    for s in sections:
        if s is None or s["begin"] is None or s["end"] is None or not last <= s["begin"] <= s["end"]:
            raise ValueError("sections have to be disjoint and sorted, without nulls")
        last = s["end"]


def attribute(low: np.ndarray, high: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, -1 for none; whether it lies in several), by an interval join.

    Sections are disjoint and sorted; the first that a token can touch is the first to end after
    the token's start, the last one is the last to begin before its end.
    """
    first = np.searchsorted(ends, low, side="right")
    last = np.searchsorted(begins, high, side="left") - 1
    # empty sections within the token's span hold none of its characters
    crossing = first < last
    chosen = (last if rule == "last" else first).copy()
    if rule == "most":
        for i in np.flatnonzero(crossing):
            held = [min(high[i], ends[s]) - max(low[i], begins[s]) for s in range(first[i], last[i] + 1)]
            chosen[i] = first[i] + int(np.argmax(held))
    chosen[first > last] = -1
    return chosen, crossing


def count_tokens(documents: DataFrame, ranks_path: str, pattern: str, rule: str = "first") -> DataFrame:
    """(doc_id, section, n_tokens, n_crossing) per section of every row with ``text`` and ``sections``.

    ``sections`` is an array of (begin, end) code point spans, disjoint and sorted, or ``sizes`` holds
    the code points of sections that follow each other. ``n_crossing`` counts the tokens of ``n_tokens``
    that lie in several sections; each is counted once, by ``rule``. Tokens outside all sections
    are counted under the section -1, so that a document's counts add up to its tokens.

    Null and empty texts: their sections with 0 tokens. Sections without tokens are returned with 0.
    Null sections, or none: all tokens are outside. A null among them or a null end, and spans that
    overlap, are unsorted or end before they begin, raise ValueError.
    Null doc_ids and repeated rows are kept, each row by itself; no rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule has to be one of {RULES}")
    held = documents.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    follow = "sizes" in documents.columns

    def step():
        ranks = held.value
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)

        def work(part):
            out = {"doc_id": [], "section": [], "n_tokens": [], "n_crossing": []}
            for i, (doc_id, text) in enumerate(zip(part["doc_id"], part["text"])):
                if follow:
                    lengths = np.array(part["sizes"][i] or [], dtype=np.int64)
                    ends = np.cumsum(lengths)
                    begins = ends - lengths
                else:
                    spans = part["sections"][i] or []
                    check(spans)
                    begins, ends = (np.array([s[k] for s in spans], dtype=np.int64) for k in ("begin", "end"))
                ids = np.array(coder.encode_ordinary(text.decode()), dtype=np.int64)
                n = len(begins)
                counts, crossed, outside = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
                if len(ids):
                    chosen, crossing = attribute(*token_spans(ids, sizes, text), begins, ends, rule)
                    counts += np.bincount(chosen[chosen >= 0], minlength=n)
                    crossed += np.bincount(chosen[crossing & (chosen >= 0)], minlength=n)
                    outside = int((chosen < 0).sum())
                out["doc_id"] += [doc_id] * (n + (outside > 0))
                out["section"] += [*range(n), *[-1] * (outside > 0)]
                out["n_tokens"] += [*counts.tolist(), *[outside] * (outside > 0)]
                out["n_crossing"] += [*crossed.tolist(), *[0] * (outside > 0)]
            return out

        return work

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "sizes" if follow else "sections")
    return in_batches(rows, f"doc_id {kind(documents)}, section long, n_tokens long, n_crossing long", step, "text")
