import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward_documents, components_of, documents, prose
from pyspark.sql import functions as F

from colscope.llm import attribution, bpe, common, jaccard, lines, notices, queries

RANKS = bpe.load_ranks(queries.RANKS)
CODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def line_dedup_by_hand(rows):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(ASCII_LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    keeper = {k: max(ids, key=order) for k, ids in holders.items() if len(k) >= 40 and len(ids) >= 5}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if keeper.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return Counter(out)


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_line_dedup_against_brute_force(spark):
    rows = awkward_documents()
    found = lines.dedup_lines(documents(spark))
    assert got(found, "doc_id", "kept_text", "n_lines", "n_dropped") == line_dedup_by_hand(rows)
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_with_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_SAMPLED", 3)
    monkeypatch.setattr(lines, "SAMPLE_PART", 2)
    rows = [(i, f"{prose(i, 10)}\n{'a hot line of more than forty characters in all' if i % 3 else 'x'}\n{prose(i % 40, 12)}\n") for i in range(300)]
    rows += [(None, "a hot line of more than forty characters in all")] * 2
    assert lines.hot_keys(documents(spark, rows)) is not None
    found = lines.dedup_lines(documents(spark, rows))
    assert got(found, "doc_id", "kept_text", "n_lines", "n_dropped") == line_dedup_by_hand(rows)


def test_line_bitmaps_leave_out_whole_words(spark):
    line = "a line of more than forty characters, is it not so?"
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(150)] + [line])) for i in range(6)]
    maps = {r["doc_id"]: r["keep"] for r in lines.keep_bitmaps(documents(spark, rows)).collect()}
    assert set(maps) == {0, 1, 2, 3, 4} and all(set(m) == {150 // 64} for m in maps.values())


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def jaccard_by_hand(rows, k=4, num=85, den=100):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if i is not None and j is not None and both and den * both >= num * (len(a) + len(b) - both):
                links.append((i, j))
    at = components_of({i for i, _ in rows if i is not None}, links)
    return Counter((i, len(s), at.get(i)) for i, s in sets)


def test_jaccard_against_brute_force(spark):
    found = jaccard.jaccard_components(documents(spark))
    assert got(found, "doc_id", "n_shingles", "component_id") == jaccard_by_hand(awkward_documents())
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [(128, 1024), (2, 3)])
def test_jaccard_finds_links_between_components(spark, monkeypatch, blocks):
    """Chains of edits: ends differ, neighbours link; the bands are shut off, so the index does the work."""
    monkeypatch.setattr(jaccard, "BLOCK_COMPONENTS", blocks[0])
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", blocks[1])
    monkeypatch.setattr(jaccard, "similar_pairs", lambda nodes, rule, frames: nodes.select(nodes.doc_id.alias("a"), nodes.doc_id.alias("b")).limit(0))
    rows, words = [], prose(3, 150).split()
    for i in range(12):
        words[10 * i] = f"edit{i}"
        rows.append((i, " ".join(words)))
    shared = prose(4, 40)
    rows += [(100 + i, f"{shared} {prose(200 + i, 30 + 5 * i)}") for i in range(12)]
    found = jaccard.jaccard_components(documents(spark, rows))
    assert got(found, "doc_id", "n_shingles", "component_id") == jaccard_by_hand(rows)


def test_jaccard_takes_repeated_rows_once(spark, monkeypatch):
    most = []

    def blocks(entries, *rest, made=jaccard.index_blocks):
        most.append(max(r["count"] for r in entries.groupBy("doc_id", "token").count().collect()))
        return made(entries, *rest)

    monkeypatch.setattr(jaccard, "index_blocks", blocks)
    rows = [(1, prose(21, 40))] * 30 + [(2, prose(22, 40)), (3, f"{prose(21, 40)} end"), (4, prose(22, 40))]
    found = jaccard.jaccard_components(documents(spark, rows))
    assert got(found, "doc_id", "n_shingles", "component_id") == jaccard_by_hand(rows) and most == [1]


def test_jaccard_other_rules(spark):
    rows = [(i, f"{prose(7, 60)} {prose(300 + i, 3)}") for i in range(8)] + [(90, "x y z"), (91, "x y z"), (92, "X y  z")]
    rule = jaccard.Rule(words=5, num=80, den=100)
    assert got(jaccard.jaccard_components(documents(spark, rows), rule), "doc_id", "n_shingles", "component_id") == jaccard_by_hand(rows, 5, 80)


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    places = [(i, label) for phrase, label in notices.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_and_fuzzy_labels(spark):
    texts = ["MIT License, mit license", "The MIT Licence", "GNU General Public\nLicense", "apache licens", "smit license", "Redistribution and use in sourc and binary forms", "", None, "İ mit-license ☃", prose(1, 5000) + " mit license"]
    rows = list(enumerate(texts)) + [(1, texts[1]), (None, "apache license")]
    found = notices.license_digest(notices.scan_licenses(documents(spark, rows))).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == Counter((i, *base_by_hand(t)) for i, t in rows)
    labels = {r.doc_id: r.labels for r in found}
    assert [labels[i] for i in range(8)] == ["mit", "mit", "gpl", "apache", "", "bsd", "", ""]
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in found)
    assert next(r for r in found if r.doc_id == 3).matches[0].asDict() == {"label": "apache", "first_word": 0, "last_word": 1, "edits": 1}
    assert notices.scan_licenses(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([n for n, _ in notices.NOTICES]), st.data())
def test_pigeonhole_misses_no_notice(notice, data):
    """Any edits up to the bound leave a piece whole, unless an edit breaks the notice's own word ends."""
    text = notice
    for _ in range(notices.errors_of(notice)):
        at = data.draw(st.integers(1, len(text) - 2))
        text = text[:at] + "q" + text[at + 1 :]
    k = [n for n, _ in notices.NOTICES].index(notice)
    joined = f" before {text} after "
    exists = bool(notices.Scanner().fuzzy[k].search(joined))
    assert exists and any(m[3] == k for m in notices.Scanner(notices=[notices.NOTICES[k]] * (k + 1)).matches(joined)) is exists


def distance(a, b):
    """Edits from b to a, none of which puts a character in front."""
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], len(a) + len(b)
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def notices_by_hand(joined, table):
    """Every word start with every word end; of overlapping places the ones with fewer edits, then the earlier."""
    blanks = [i for i, c in enumerate(joined) if c == " "]
    found = []
    for k, (notice, _) in enumerate(table):
        most, taken = notices.errors_of(notice), []
        spans = [(a + 1, b) for a in blanks for b in blanks if abs(b - a - 1 - len(notice)) <= most]
        edits = {(a, b): distance(joined[a:b], notice) for a, b in spans}
        best = {}
        for (a, b), n in sorted(edits.items()):
            if n <= most and (a not in best or n < best[a][0]):
                best[a] = (n, b)
        for n, a, b in sorted((n, a, b) for a, (n, b) in best.items()):
            if all(b <= x or y <= a for x, y, _, _ in taken):
                taken.append((a, b, n, k))
        found += taken
    clash = lambda m, o: o[2] < m[2] and m[0] < o[1] and o[0] < m[1] and table[o[3]][1] != table[m[3]][1]
    return sorted(m for m in found if not any(clash(m, o) for o in found))


SCANNER = notices.Scanner()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([n for n, _ in notices.NOTICES] + ["the", "mit", "a license"]), min_size=1, max_size=4), st.data())
def test_licenses_against_brute_force(parts, data):
    """Notices side by side, with letters and blanks inserted, deleted and replaced."""
    text = " ".join(parts)
    for _ in range(data.draw(st.integers(0, 6))):
        at, what = data.draw(st.integers(0, len(text) - 1)), data.draw(st.sampled_from(["", "q", "e", " ", "xl"]))
        text = text[:at] + what + text[at + data.draw(st.integers(0, 1)) :]
        text = text or "x"
    joined = f" {' '.join(text.split())} "
    assert SCANNER.matches(joined) == notices_by_hand(joined, notices.NOTICES)


@pytest.mark.parametrize("text, spans", [("apache licens apache license", [(0, 1, 1), (2, 3, 0)]), ("mit licnse mit license", [(0, 1, 1), (2, 3, 0)]), ("mit license mit licence x mit licnse", [(0, 1, 0), (2, 3, 1), (5, 6, 1)])])
def test_neighbouring_notices_keep_their_spans(text, spans):
    assert [(m["first_word"], m["last_word"], m["edits"]) for m in SCANNER.scan(text.encode())["matches"]] == spans


def test_bpe_against_tiktoken(spark):
    rows = awkward_documents() + [(50, "x" * 3000 + "ab" * 500 + "☃" * 300 + " \n\n  \t"), (51, "<|endoftext|>")]
    found = bpe.token_digests(bpe.encode_documents(documents(spark, rows), queries.RANKS, public_tokenizers.PATTERN))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, CODER.encode_ordinary(t or ""), t or "") for i, t in rows]
    assert got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter((i, len(x), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, x, t in ids)
    assert bpe.encode_documents(documents(spark, []), queries.RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(text):
    encoder, decoder = bpe.coders(RANKS, public_tokenizers.PATTERN)
    ids = encoder.encode(text)
    assert ids == CODER.encode_ordinary(text) and decoder.decode(ids, 3) == text


def test_bpe_tables_start_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = prose(9, 400) + " unquestionable antidisestablishmentarianism"
    assert encoder.encode(text) == CODER.encode_ordinary(text) and len(encoder.known) <= 20


def test_bpe_pieces_met_again_outlast_the_others(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for i in range(200):
        encoder.encode(f" again seldom{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{i // 100 * 'x'}")
        assert " again" in encoder.known or " again" in encoder.older
        assert len(encoder.known) <= 20 and len(encoder.older) <= 20


def test_bpe_tables_take_little_of_a_worker():
    tracemalloc.start()
    try:
        encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
        before = tracemalloc.get_traced_memory()[0]
        rng = random.Random(5)
        for _ in range(800):
            encoder.encode(" " + "".join(rng.choice("etaoinshrdlu") for _ in range(8)))
        held = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    # 24 MB and 729 bytes a transition before
    assert before < 17e6 and held / len(encoder.machine.moves) < 690


def test_line_totals_are_a_local_table(spark, monkeypatch):
    # rows of Python objects would start a second Python daemon in every executor, with workers of its own
    monkeypatch.setattr(lines, "SAMPLE_PART", 1)
    monkeypatch.setattr(lines, "HOT_SAMPLED", 1)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a line that is long enough to be looked at in every document").alias("text"))
    gone = lines.dropped_lines(docs)
    assert "ExistingRDD" not in gone._jdf.queryExecution().toString() and gone.count() == 39


def test_worker_tables_last_until_another_step():
    made = []
    one = lambda: made.append(1) or len(made)
    keeps, other = (lambda: None), (lambda: None)
    keeps.tables = "own"
    assert [common.worker_tables("own", key, one) for key in (("a",), ("a",), ("b",))] == [1, 1, 2]
    common.drop_tables(keeps)
    assert common.worker_tables("own", ("b",), one) == 2
    common.drop_tables(other)
    assert common.worker_tables("own", ("b",), one) == 3
    common.drop_tables(other)


def attributed_by_hand(text, rule):
    """Every token's characters one by one."""
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line) + 1))
        at += len(line) + 1
    counts, crossing, byte = Counter(), Counter(), 0
    for i in CODER.encode_ordinary(text):
        size = len(CODER.decode_single_token_bytes(i))
        points = sorted({p for p in range(len(text)) if len(text[:p].encode()) < byte + size and len(text[: p + 1].encode()) > byte})
        held = Counter(next(s for s, (a, b) in enumerate(spans) if a <= p < b) for p in points)
        best = {"first": min(held), "last": max(held), "most": min(held, key=lambda s: (-held[s], s))}[rule]
        counts[best] += 1
        crossing[best] += len(held) > 1
        byte += size
    return [(s, counts[s], crossing[s]) for s in range(len(spans))]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_attribution_against_brute_force(spark, rule):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "a ☃𝄞\n\n b\n  c\t\nñandú é"), (5, prose(1, 30) + "\n" + prose(2, 3)), (5, "again"), (6, "x;\n\n\n  y = {\n\n}\n"), (None, "x\ny")]
    found = attribution.count_tokens(attribution.line_sections(documents(spark, rows)), queries.RANKS, public_tokenizers.PATTERN, rule)
    expected = Counter((i, *x) for i, t in rows for x in attributed_by_hand(t or "", rule))
    assert sum(n for *_, n in expected) > 0
    assert got(found, "doc_id", "section", "n_tokens", "n_crossing") == expected


def test_token_attribution_outside_sections(spark):
    made = spark.createDataFrame([(1, "hello brave new world", [(0, 5), (12, 15)])], "doc_id long, text string, sections array<struct<begin: long, end: long>>")
    found = attribution.count_tokens(made, queries.RANKS, public_tokenizers.PATTERN)
    assert got(found, "section", "n_tokens") == Counter({(0, 1): 1, (1, 1): 1, (-1, 2): 1})
    with pytest.raises(ValueError):
        attribution.count_tokens(made, queries.RANKS, public_tokenizers.PATTERN, "none")
    bare = made.withColumn("sections", F.lit(None).cast(made.schema["sections"].dataType))
    assert got(attribution.count_tokens(bare, queries.RANKS, public_tokenizers.PATTERN), "section", "n_tokens") == Counter({(-1, 4): 1})
    for wrong in ([(0, 5), (3, 8)], [(6, 8), (0, 5)], [(4, 2)], [(None, 5)], [None]):
        with pytest.raises(ValueError):
            attribution.check([None if s is None else dict(zip(("begin", "end"), s)) for s in wrong])


def test_token_attribution_is_linear_in_lines(spark):
    text = "a line\n" * 200_000
    begin = time.monotonic()
    found = attribution.count_tokens(attribution.line_sections(documents(spark, [(1, text)])), queries.RANKS, public_tokenizers.PATTERN)
    total = found.agg(F.count("section").alias("lines"), F.sum("n_tokens").alias("tokens")).first()
    assert (total.lines, total.tokens) == (200_001, len(CODER.encode_ordinary(text))) and time.monotonic() - begin < 60
