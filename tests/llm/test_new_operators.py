import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward_documents, documents, prose

from colscope.llm import bpe, fim, pii, queries, whiten

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def fim_by_hand(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n, digest = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [fim.FRAME_BYTES, 7])
def test_fill_in_middle_against_brute_force(spark, size):
    rows = awkward_documents() + [(100 + i, f" é☃ {prose(i, 20)} <P{'>' if i % 5 == 0 else ''} x\x1fy\t\n 𝄞" + " " * (i % 4)) for i in range(40)]
    rows += [(200, "x" * 300_000), (201, " " * 70_000), (203, "<P>"), (204, "<" * 50), (205, "<S <P <M")]
    if size < 10:
        rows = [(i, t and t[:3000]) for i, t in rows]
    made = fim.fill_in_middle(documents(spark, rows), size)
    by_hand = [(i, *fim_by_hand(i, t)) for i, t in rows]
    assert {x[2] for x in by_hand} == {"plain", "spm", "psm"}
    found = got(fim.with_sums(made), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert found == Counter((*x[:5], sha(x[5]), sha(t or "")) for x, (_, t) in zip(by_hand, rows))
    assert got(fim.texts_of(made), "doc_id", "text") == Counter((x[0], x[5]) for x in by_hand)
    assert got(fim.texts_of(made, restore=True), "doc_id", "text") == Counter((i, t or "") for i, t in rows)
    assert fim.with_sums(fim.fill_in_middle(documents(spark, []))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\nab<PSM>é☃", max_size=60), st.integers(1, 9))
def test_frames_seek_every_unit(text, size):
    store = fim.Store(fim.pack(text.encode(), size))
    units = UNITS.findall(text)
    assert (store.units[-1] if store.frames else 0) == len(units)
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert store.seek(k) == (len(before.encode()), len(before))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab<PS>", max_size=12), min_size=3, max_size=3), st.sampled_from(["spm", "psm"]), st.integers(1, 5))
def test_restoring_reads_marks_across_pieces(parts, form, size):
    p, m, s = (x.replace(">", "") for x in parts)
    output = (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}").encode()
    pieces = [output[i : i + size] for i in range(0, len(output), size)]
    assert b"".join(fim.restored(pieces, form)).decode() == p + m + s


def test_whole_frames_are_moved_unopened(spark):
    text = prose(5, 30_000)
    doc_id = next(i for i in range(100) if fim.plan(30_000, False, i)[0] != "plain")
    stored = fim.store_frames(documents(spark, [(doc_id, text)]), 4096)
    before = {bytes(f["data"]) for f in stored.first()["frames"]}
    output = [bytes(x) for x in fim.rearrange(stored).first()["output"]]
    assert len(before - set(output)) <= 2
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(b"".join(output)).decode() == fim_by_hand(doc_id, text)[4]


def embeddings(spark, rows):
    made = [(i, v, 1, 0.5, "k") for i, v in rows]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>, label int, x double, i string").repartition(5)


def whiten_by_hand(rows, wanted=8):
    """vec_id to (deviation, whitened), shares; over the whole covariance, with exact sums."""
    used = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, x = len(used), np.array([v for _, v in used], dtype=object)
    away = x * n - x.sum(axis=0)
    centred = away.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    return used, (away * away).sum(axis=1), centred @ vectors / np.sqrt(values), values / (centred**2).sum() * n


def check_whitening(spark, rows, **how):
    found = whiten.whiten_embeddings(embeddings(spark, rows), **how).collect()
    used, deviation, expected, shares = whiten_by_hand(rows)
    k = expected.shape[1]
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in found) == Counter((i, c + 1, len(used), d) for (i, _), d in zip(used, deviation) for c in range(k))
    by_place = {(r.vec_id, r.component): r.whitened for r in found if r.vec_id is not None}
    mine = np.array([[by_place[i, c + 1] for c in range(k)] for i, _ in used if i is not None])
    theirs = np.array([w for (i, _), w in zip(used, expected) if i is not None])
    signs = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine - theirs * signs).max() < 1e-8
    assert all(math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9 for r in found)


def test_whitening_against_the_whole_covariance(spark):
    pick = np.random.default_rng(3)
    rows = [(i, (pick.standard_normal(48) * np.linspace(1, 0.7, 48) / 7).tolist()) for i in range(700)]
    rows += [(700, None), (701, []), (702, [None] + [0.1] * 47), (703, [math.nan] * 48), (704, [math.inf] + [0.0] * 47), (705, [0.3] * 48), (5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1]), (706, [0.1] * 7)]
    check_whitening(spark, [r for r in rows if r[0] != 706], block=16)
    assert 706 not in {r.vec_id for r in whiten.whole_vectors(embeddings(spark, rows)).collect()}


@pytest.mark.parametrize("spread", [np.ones(40), np.r_[np.full(10, 1.0), np.full(30, 0.999)], np.r_[1000.0, np.linspace(1, 0.5, 39)]])
def test_whitening_of_awkward_spectra(spark, spread):
    pick = np.random.default_rng(4)
    check_whitening(spark, [(i, (pick.standard_normal(40) * spread).tolist()) for i in range(900)], block=16)


def test_whitening_of_few_dimensions_and_few_rows(spark):
    pick = np.random.default_rng(5)
    check_whitening(spark, [(i, pick.standard_normal(3).tolist()) for i in range(50)])
    for rows in ([], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(6)], [(1, None)]):
        assert whiten.whiten_embeddings(embeddings(spark, rows)).count() == 0
    line = [(i, [0.125 * i, 0.25 * i, 0.0]) for i in range(9)]
    assert {r.component for r in whiten.whiten_embeddings(embeddings(spark, line)).collect()} == {1}


def test_whitening_counts_beyond_64_bits(spark):
    rows = [(i, [1e9 * (i % 7), 1e9 * (i % 5)]) for i in range(60)]
    frame = whiten.whole_vectors(embeddings(spark, rows))
    used, deviation, _, _ = whiten_by_hand(rows)
    assert got(whiten.whitened(frame, whiten.fit(frame)), "vec_id", "deviation") == Counter((i, d) for (i, _), d in zip(used, deviation)) and max(deviation) > 1 << 63
    assert {r.deviation for r in whiten.whiten_embeddings(embeddings(spark, rows)).collect()} <= {d if d < 1 << 63 else None for d in deviation}


def test_whitening_certifies_with_few_passes(spark):
    pick = np.random.default_rng(6)
    frame = whiten.whole_vectors(embeddings(spark, [(i, (pick.standard_normal(64) / 8).tolist()) for i in range(2000)]))
    model = whiten.fit(frame)
    assert model.errors.max() <= 1e-9 and model.passes < 120


def base_by_hand(text):
    """The patterns as they are stated, one after the other."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    stated = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), name) for k, (name, pattern, holds) in enumerate(stated) for m in re.finditer(pattern, text) if holds(m.group()))


PERSONAL = [
    "a@b.c_x@d.e @x.y a@b a@b. .%+-@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111", "+1 (017) 555-7713 +12 3 +4 9.30-1234567( ++49 30 1234567890",
    "a.b@c.d@e.f 1.1.1.1@x.yz +1 4111 1111 1111 1111", "ünï@exämple.com x@y.z☃ 𝄞 9.9.9.9", "++1234567890123456 4111 1111  1111 1111 0000 0000 0000 00",
]


def test_personal_data_base_against_the_stated_patterns(spark):
    rows = awkward_documents() + list(enumerate(PERSONAL, 300)) + [(300, PERSONAL[0]), (None, PERSONAL[1]), (320, f"{prose(1, 9000)} me@here.org {prose(2, 9000)} 10.0.0.1")]
    found = pii.personal_data_digest(pii.find_personal_data(documents(spark, rows)))
    expected = []
    for i, text in rows:
        base = base_by_hand(text or "")
        listed = ",".join(f"{name}:{a}:{b}" for a, _, b, name in base)
        expected.append((i, *(sum(name == k for *_, name in base) for k in pii.KINDS), sha(listed), listed))
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == Counter(expected)
    assert pii.find_personal_data(documents(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.9@+ -()%0☃４", max_size=40))
def test_personal_data_base_on_any_text(text):
    base, spans = FINDER.find(text)
    assert base == [x[:3] for x in base_by_hand(text)] and set(base) <= set(spans)


FINDER = pii.Finder()
IDENTIFIERS = [("email", "john.doe@mail.example.com"), ("email", "x_1@host.org"), ("ip", "192.168.1.77"), ("card", "4111 1111 1111 1111"), ("phone", "+44 20 7946 0958")]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(IDENTIFIERS), st.data())
def test_disguised_identifiers_are_found_where_they_stand(identifier, data):
    kind, plain = identifier
    at = data.draw(st.sampled_from(["@", " [at] ", "(at)", "{ At }", "＠", "[@]"]))
    dot = data.draw(st.sampled_from([".", " [dot] ", "(DOT)", "．", "[.]"])) if kind in ("email", "ip") else "."
    like = data.draw(st.booleans())
    made = ""
    for c in plain:
        others = [k for k, v in pii.LOOK_ALIKES.items() if k == c] if c.isalpha() else []
        if c == "@":
            made += at
        elif c == ".":
            made += dot
        elif like and others and data.draw(st.booleans()):
            made += pii.LOOK_ALIKES[c][0]
        elif like and c.isdigit() and data.draw(st.booleans()):
            made += chr(ord("０") + int(c))
        else:
            made += c + ("​" if like and data.draw(st.integers(0, 9)) == 0 else "")
    made = made.rstrip("​")
    before, after = "said on oneday, ", " and went"
    base, spans = FINDER.find(before + made + after)
    found = (len(before), pii.KINDS.index(kind), len(before) + len(made))
    assert found in spans
    assert all(found[0] <= a and b <= found[2] for a, _, b in spans)


@pytest.mark.parametrize("kind, plain", [("ip", "10.20.30.140"), ("card", "4111111111111111"), ("phone", "+442079460958")])
@pytest.mark.parametrize("words", pii.DIGIT_WORDS)
def test_spelled_numbers(kind, plain, words):
    names = {str(i): w for i, w in enumerate(words.split())} | {".": "dot", "+": "plus"}
    made = " ".join(names[c] for c in plain)
    for text in (made, made.upper() if "ß" not in made else made):
        assert FINDER.find(f"☃ it is {text}, yes")[1] == [(8, pii.KINDS.index(kind), 8 + len(text))]


def test_clean_texts_have_no_spans():
    for text in ("look at example.com", "we are at polka dot party", "one two three", "room at one dot two", "call one eight hundred at noon", "+1 (017) 555-7713 – 24 hours one of us", "at dot", "dot com", "[at][dot]", "x [at] y", "İ at a dot", "null null null null", "f­ive"):
        base, spans = FINDER.find(text)
        assert spans == base == [x[:3] for x in base_by_hand(text)], text
    assert FINDER.find("john at example dot co dot uk now")[1] == [(0, 0, 29)]
    assert FINDER.find("a@b.co [dot] uk")[1] == [(0, 0, 6), (0, 0, 15)]


def test_long_texts_take_linear_time():
    import time

    started = time.time()
    for unit in ("a", "1", "a@", "1.", "+1", "at ", "one ", " dot", "@.", "　", "1 ", "x at y dot ", "([{<", "​", "４.", "plus "):
        FINDER.find(unit * (300_000 // len(unit)))
    assert time.time() - started < 60


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.data())
def test_spans_map_back_through_edits(text, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=6)))
    edits = [(a, b, data.draw(st.sampled_from(["", "X", "YZ"]))) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]
    made = pii.Aligned(text, edits)
    origin, at = [], 0
    for a, b, out in [*edits, (len(text), len(text), "")]:
        origin += [(i, i + 1) for i in range(at, a)] + [(a, b)] * len(out)
        at = b
    assert len(made.text) == len(origin)
    for i in range(len(origin)):
        for j in range(i + 1, len(origin) + 1):
            assert made.span(i, j) == (origin[i][0], origin[j - 1][1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x1c\xa0\x85  aé1.'s☃", max_size=30))
def test_bpe_of_odd_white_space(text):
    assert ENCODER.encode(text) == CODER.encode_ordinary(text)


RANKS = bpe.load_ranks(queries.RANKS)
CODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
