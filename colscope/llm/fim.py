"""Fill-in-middle: texts stored as seekable compressed frames, cut by unit counts and put together in a new order.

A text becomes a row of independent zstandard frames of bounded size, each with the units, characters
and bytes counted up to its end. A cut after the u-th unit is found by those counts and by opening one
frame; the output is a new row of frames, in which all frames but the cut ones are moved as they are.
Digests open one frame after the other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import Frames, in_batches, utf8

# Bytes of text in a frame, and the level at which frames are compressed.
FRAME_BYTES = 256 << 10
LEVEL = 3

# The marks, and the shares of a hundred that are rearranged and that take the form spm.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
REARRANGED, SPM = 50, 80
SEED = 42

FRAME = "struct<units: bigint, chars: bigint, bytes: bigint, data: binary>"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def pack(text: bytes, size: int) -> list[dict]:
    """The frames of a text, with units ended, characters begun and bytes up to the end of each.

    A frame may end anywhere: a unit belongs to the frame that holds its last byte.
    """
    frames, units, chars = [], 0, 0
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    for start in range(0, len(text), size):
        part = text[start : start + size]
        units += len(unit_ends(part, text[start + size : start + size + 1]))
        chars += characters(part)
        frames.append({"units": units, "chars": chars, "bytes": start + len(part), "data": squeeze(part)})
    return frames


def unit_ends(part: bytes, after: bytes) -> np.ndarray:
    """Where units end in a part of a text, as offsets after their last byte; ``after`` is the next byte, if any.

    A unit ends where a word is followed by white space, and at the end of the text.
    """
    space = SPACE[np.frombuffer(part + after, dtype=np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return ends if after else np.append(ends, len(part))


def characters(part: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(part, dtype=np.uint8) & 0xC0 != 0x80))


class Store:
    """One text as frames: seeks by unit, and streams any range of bytes."""

    def __init__(self, frames: list[dict]):
        self.frames = frames
        self.units = [f["units"] for f in frames]
        self.ends = [f["bytes"] for f in frames]
        self.open = zstandard.ZstdDecompressor().decompress
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        self.opened: dict[int, bytes] = {}

    def frame(self, i: int) -> bytes:
        if i not in self.opened:
            if len(self.opened) > 1:
                del self.opened[min(self.opened)]
            self.opened[i] = self.open(self.frames[i]["data"])
        return self.opened[i]

    def seek(self, units: int) -> tuple[int, int]:
        """(bytes, characters) before the end of the unit of that number, counted from 1; 0 is the start."""
        if not units:
            return 0, 0
        i = bisect_left(self.units, units)
        before = self.frames[i - 1] if i else {"units": 0, "chars": 0, "bytes": 0}
        part = self.frame(i)
        # a unit that ends with its frame has the number that the frame closes with
        inside = unit_ends(part, b"x")
        nth = units - before["units"]
        offset = int(inside[nth - 1]) if nth <= len(inside) else len(part)
        return before["bytes"] + offset, before["chars"] + characters(part[:offset])

    def moved(self, start: int, stop: int) -> Iterator[bytes]:
        """Frames that hold the bytes from ``start`` to ``stop``: whole ones as they are, cut ones anew."""
        if start >= stop:
            return
        for i in range(bisect_left(self.ends, start + 1), len(self.frames)):
            low = self.ends[i - 1] if i else 0
            if low >= stop:
                return
            a, b = max(start, low) - low, min(stop, self.ends[i]) - low
            yield self.frames[i]["data"] if (a, b) == (0, self.ends[i] - low) else self.squeeze(self.frame(i)[a:b])


def draws(doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def plan(n: int, marked: bool, doc_id) -> tuple[str, int, int]:
    """Form, and the units before the first and the second cut."""
    one, two, three, four = draws(doc_id)
    first, second = sorted((one % (n + 1), two % (n + 1)))
    if not n or marked or three % 100 >= REARRANGED:
        return "plain", first, second
    return "spm" if four % 100 < SPM else "psm", first, second


def store_frames(documents: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, marked, size, frames) of every row: whether the text contains a mark, and the bytes of its frames.

    Null and empty texts have no frames. Null doc_ids and repeated rows are kept, other columns are
    not looked at, no rows give no rows.
    """

    def step():
        def work(part):
            texts = part["text"]
            marked = [any(mark in t for mark in (PREFIX, SUFFIX, MIDDLE)) for t in texts]
            frames = [pack(t, size) for t in texts]
            return {"doc_id": part["doc_id"], "marked": marked, "size": [sum(len(f["data"]) for f in x) for x in frames], "frames": frames}

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    return in_batches(documents.select("doc_id", utf8()), f"doc_id {kind}, marked boolean, size bigint, frames array<{FRAME}>", step, "text")


def rearrange(stored: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, size, output) of rows of ``store_frames``.

    ``output`` is the new text as an array of zstandard frames; one after the other they are a
    valid zstandard file. Prefix and middle are null in the form plain. A doc_id that is null draws
    by an empty number; rows of one doc_id draw alike.
    """

    def step():
        one = zstandard.ZstdCompressor(level=LEVEL).compress
        mark = {m: one(m) for m in (PREFIX, SUFFIX, MIDDLE)}

        def made(doc_id, marked, frames):
            store = Store(frames)
            n = store.units[-1] if frames else 0
            form, first, second = plan(n, marked, doc_id)
            if form == "plain":
                return n, form, None, None, [f["data"] for f in frames]
            (a, chars_a), (b, chars_b) = store.seek(first), store.seek(second)
            prefix, middle, suffix = store.moved(0, a), store.moved(a, b), store.moved(b, store.ends[-1])
            order = [(SUFFIX, suffix), (PREFIX, prefix)] if form == "spm" else [(PREFIX, prefix), (SUFFIX, suffix)]
            output = [frame for name, frames_of in [*order, (MIDDLE, middle)] for frame in (mark[name], *frames_of)]
            return n, form, chars_a, chars_b - chars_a, output

        def work(part):
            rows = [made(*row) for row in zip(part["doc_id"], part["marked"], part["frames"])]
            names = ("n", "form", "prefix_chars", "middle_chars", "output")
            return {"doc_id": part["doc_id"], "size": part["size"], **{name: [row[i] for row in rows] for i, name in enumerate(names)}}

        return work

    kind = stored.schema["doc_id"].dataType.simpleString()
    return in_batches(stored, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, size bigint, output array<binary>", step, "size")


def opened(output: list[bytes]) -> Iterator[bytes]:
    """The text of the frames, one frame at a time."""
    read = zstandard.ZstdDecompressor().decompress
    return (read(frame) for frame in output)


def restored(pieces: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The text before it was rearranged, from the pieces of an output and its form.

    Marks may be cut by the ends of pieces. Prefix and middle pass through, since they stand in
    their old order; the suffix waits in compressed pieces.
    """
    if form == "plain":
        yield from pieces
        return
    order = {"spm": [SUFFIX, PREFIX, MIDDLE], "psm": [PREFIX, SUFFIX, MIDDLE]}[form]
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    waiting, part, held = [], None, b""

    def out(part, piece):
        if part != SUFFIX:
            yield piece
        elif piece:
            waiting.append(squeeze(piece))

    for piece in pieces:
        held += piece
        while order and (at := held.find(order[0])) >= 0:
            yield from out(part, held[:at])
            held = held[at + len(order[0]) :]
            part = order.pop(0)
        # what may be the beginning of the next mark waits for the next piece
        keep = len(held) if not order else max(0, len(held) - len(order[0]) + 1)
        yield from out(part, held[:keep])
        held = held[keep:]
    yield from out(part, held)
    yield from opened(waiting)


def with_sums(rearranged: DataFrame) -> DataFrame:
    """The columns of ``rearrange`` but the output, and the SHA-256 of the output and of the text restored from it."""
    others = [f for f in rearranged.schema.fields if f.name != "output"]

    def step():
        def sums(output, form):
            whole, back = hashlib.sha256(), hashlib.sha256()

            def read():
                for piece in opened(output):
                    whole.update(piece)
                    yield piece

            for piece in restored(read(), form):
                back.update(piece)
            return whole.hexdigest(), back.hexdigest()

        def work(part):
            found = [sums(o, f) for o, f in zip(part["output"], part["form"])]
            return {f.name: part[f.name] for f in others} | {"output_sha256": [x for x, _ in found], "restored_sha256": [x for _, x in found]}

        return work

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return in_batches(rearranged, f"{kinds}, output_sha256 string, restored_sha256 string", step, "size")


def texts_of(rearranged: DataFrame, restore: bool = False) -> DataFrame:
    """(doc_id, form, text): the outputs as texts, or the texts restored from them."""

    def step():
        whole: Callable = lambda output, form: b"".join(restored(opened(output), form if restore else "plain")).decode()
        return lambda part: {"doc_id": part["doc_id"], "form": part["form"], "text": [whole(*x) for x in zip(part["output"], part["form"])]}

    kind = rearranged.schema["doc_id"].dataType.simpleString()
    return in_batches(rearranged.select("doc_id", "form", "size", "output"), f"doc_id {kind}, form string, text string", step, "size")


def fill_in_middle(documents: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """``rearrange`` over frames that are written to the shared folder first.

    Texts are cut and compressed once; a lost executor opens frames again and reads no text anew.
    """
    return rearrange(Frames(documents.sparkSession).keep(store_frames(documents, size)))
