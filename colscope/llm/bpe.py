"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes."""

from __future__ import annotations

import base64
import codecs
import gc
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, utf8, worker_tables

# Bounds of what a worker keeps: transitions, encoded pieces and pairs of tokens. Beyond them the
# tables start afresh, which costs time and changes nothing.
MAX_TRANSITIONS = 400_000
MAX_PIECES = 150_000
MAX_PAIRS = 240_000
KEPT_PIECE = 64
# Bytes of text that a worker turns into ids at a time: they are many times as large as Python lists.
AT_ONCE = 1 << 20
# The name under which a worker keeps its coder from task to task.
TABLES = "byte_bpe"

# Places of the fields of a hypothesis.
FIELD_BITS = 22
FIELD = (1 << FIELD_BITS) - 1
PENDING, LAST = FIELD_BITS, 2 * FIELD_BITS


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file. Read on the driver; tasks get a copy of fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The plain statement of BPE: join the neighbours of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece in, token ids out.

    A hypothesis is a sequence of whole tokens followed by a path in the trie of tokens. A sequence
    of tokens is an encoding exactly when all neighbours are what ``merged`` makes of their joined
    bytes, so a hypothesis closes a token only if it agrees with the one before. The live hypotheses
    (last token, trie node, tokens not yet emitted) form one deterministic state; tokens that all of
    them share are emitted. States and transitions are made when first met and then looked up.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # the trie: node and byte to the next node, whether a node has one, and the token that ends there
        self.children: dict[int, int] = {}
        self.inner, self.token_at = bytearray(1), array("q", [-1])
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                place = node << 8 | byte
                if place not in self.children:
                    self.children[place] = len(self.token_at)
                    self.inner[node] = 1
                    self.inner.append(0)
                    self.token_at.append(-1)
                node = self.children[place]
            self.token_at[node] = rank
        if len(self.token_at) > FIELD or max(ranks.values(), default=0) >= 1 << 64 - LAST - 1:
            raise ValueError("too many tokens for the fields of a hypothesis")
        self.agreed: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.reset()

    def reset(self) -> None:
        # a hypothesis is one number: last token + 1, pending tokens (a place in outputs), trie node;
        # a state's numbers are kept as bytes, a third of the size of a tuple
        start = array("Q", [0]).tobytes()
        self.sets: list[bytes] = [start]
        self.states: dict[bytes, int] = {start: 0}
        # state and byte to the next state and, in the lower bits, what is emitted: one number each
        self.moves: dict[int, int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_of: dict[tuple[int, ...], int] = {(): 0}
        self.ends: dict[int, tuple[int, ...]] = {}

    def output(self, tokens: tuple[int, ...]) -> int:
        """The place of the tokens in ``outputs``."""
        place = self.output_of.setdefault(tokens, len(self.outputs))
        if place == len(self.outputs):
            self.outputs.append(tokens)
        return place

    def spine(self, token: int) -> tuple[list, list] | None:
        """The parts that stand at the left and at the right edge of a token while it is put together.

        Each as (bytes, born, gone): the ranks of the joins that make the part and take it away.
        None for a token that its own bytes do not lead to, or not by joins of rising rank.
        """
        if token not in self.edges:
            parts = [(bytes([b]), -1) for b in self.bytes_of[token]]
            left, right, now, rising = [(parts[0][0], -1)], [(parts[-1][0], -1)], -1, True
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i][0] + parts[i + 1][0], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                rising, now = rising and rank >= now, rank
                parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], rank)]
                if at == 0:
                    left.append(parts[0])
                if at == len(parts) - 1:
                    right.append(parts[-1])
            gone = lambda side: [(x, born, then) for (x, born), (_, then) in zip(side, [*side[1:], (b"", 1 << 60)])]
            self.edges[token] = (gone(left), gone(right)) if len(parts) == 1 and rising else None
        return self.edges[token]

    def agrees(self, before: int, token: int) -> bool:
        """Whether the two tokens stay apart: no join of two parts at their common edge comes first."""
        pair = (before + 1) << 32 | token
        known = self.agreed.get(pair)
        if known is not None:
            return known
        if len(self.agreed) >= MAX_PAIRS:
            self.agreed.clear()
        first, second = self.spine(before) if before >= 0 else ((), ()), self.spine(token)
        if before < 0:
            known = second is not None or merged(self.ranks, self.bytes_of[token]) == [token]
        elif first is None or second is None:
            known = merged(self.ranks, self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        else:
            known = not self.meet(first[1], second[0])
        self.agreed[pair] = known
        return known

    def meet(self, before: list, after: list) -> bool:
        """Whether two parts that stand side by side at a time are joined before either goes.

        Both edges hold one part at any time, so a walk along them meets all pairs that ever stand together.
        """
        rank, i, j = self.ranks.get, 0, 0
        while True:
            (x, born, gone), (y, born_too, gone_too) = before[i], after[j]
            if (join := rank(x + y)) is not None and (now := max(join, born, born_too)) < gone and now <= gone_too:
                return True
            if i + 1 == len(before) and j + 1 == len(after):
                return False
            i, j = i + (gone <= gone_too), j + (gone_too <= gone)

    def move(self, state: int, byte: int) -> int:
        """The state after one more byte, and the number of the tokens that are certain by then."""
        live, closed = [], None
        children, inner, token_at, agreed, outputs = self.children.get, self.inner, self.token_at, self.agreed.get, self.outputs
        for hypothesis in array("Q", self.sets[state]):
            node = hypothesis & FIELD
            child = children(node << 8 | byte)
            if child is None:
                continue
            if inner[child]:
                live.append(hypothesis - node + child)
            # a run of bytes has one encoding, so at most one hypothesis closes here
            if closed is None and (token := token_at[child]) >= 0:
                last = hypothesis >> LAST
                agrees = agreed(last << 32 | token)
                if self.agrees(last - 1, token) if agrees is None else agrees:
                    pending = self.output((*outputs[hypothesis >> PENDING & FIELD], token))
                    closed = (token + 1) << LAST | pending << PENDING
        # the oldest start, which has the deepest node, comes first: equal sets have one order
        if closed is not None:
            live.append(closed)
        pending = [outputs[x >> PENDING & FIELD] for x in live]
        first = min(pending, key=len)
        shared = len(first)
        if shared:
            for other in pending:
                while shared and other[:shared] != first[:shared]:
                    shared -= 1
        if shared:
            live = [x >> LAST << LAST | self.output(p[shared:]) << PENDING | x & FIELD for x, p in zip(live, pending)]
        after = array("Q", live).tobytes()
        number = self.states.get(after)
        if number is None:
            number = self.states[after] = len(self.sets)
            self.sets.append(after)
        made = self.moves[state << 8 | byte] = number << FIELD_BITS | self.output(first[:shared])
        return made

    def end(self, state: int) -> tuple[int, ...]:
        """The tokens still pending when the piece ends: of the hypothesis that stands between tokens."""
        known = self.ends.get(state)
        if known is None:
            known = self.ends[state] = next(self.outputs[x >> PENDING & FIELD] for x in array("Q", self.sets[state]) if x & FIELD == 0)
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) >= MAX_TRANSITIONS or len(self.outputs) > FIELD // 2:
            self.reset()
        state, out, known, outputs = 0, [], self.moves.get, self.outputs
        for byte in piece:
            step = known(state << 8 | byte) or self.move(state, byte)
            state = step >> FIELD_BITS
            if emitted := step & FIELD:
                out += outputs[emitted]
        out += self.end(state)
        return out


class Encoder:
    """Whole texts to token ids, each match of the pattern by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        # pieces met lately, and those met before them: what is met again moves up, the rest goes
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece) or self.older.get(piece) or tuple(self.machine.encode(piece.encode()))
        if len(piece) <= KEPT_PIECE:
            if len(self.known) >= MAX_PIECES:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, piece = self.known.get, self.piece
        return list(chain.from_iterable([known(p) or piece(p) for p in self.pieces(text)]))


class Decoder:
    """Token ids to text, as they come: whole code points leave at once, a cut one waits for its rest."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = {rank: token for token, rank in ranks.items()}

    def stream(self, ids: Iterable[Iterable[int]]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        token = self.table.__getitem__
        for some in ids:
            yield machine.decode(b"".join(map(token, some)))
        yield machine.decode(b"", True)

    def decode(self, ids: list[int], at_once: int = 4096) -> str:
        return "".join(self.stream(ids[i : i + at_once] for i in range(0, len(ids), at_once)))


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: ids of the whole text, and the text they decode to.

    Null and empty texts have no tokens and decode to an empty text; null doc_ids and repeated rows
    are kept as they are; no rows give no rows. Other columns are not looked at. No special tokens.
    """
    held = documents.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    key = (uuid.uuid4().hex, pattern)

    def step():
        encoder, decoder = worker_tables(TABLES, key, lambda: coders(held.value, pattern))
        # the tables hold millions of tuples and no cycles
        gc.disable()

        def work(rows):
            ids = [encoder.encode(t.decode()) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [decoder.decode(x) for x in ids]}

        work.close = gc.enable
        return work

    step.tables = TABLES

    return in_batches(documents.select("doc_id", utf8()), f"doc_id {kind(documents)}, n_tokens long, ids array<int>, decoded string", step, "text", AT_ONCE)


def kind(documents: DataFrame) -> str:
    return documents.schema["doc_id"].dataType.simpleString()


def coders(ranks: dict[bytes, int], pattern: str) -> tuple[Encoder, Decoder]:
    return Encoder(ranks, pattern), Decoder(ranks)


def token_digests(encoded: DataFrame) -> DataFrame:
    """The digests of ``encode_documents``: ids in decimal joined by one blank, and the decoded bytes."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
