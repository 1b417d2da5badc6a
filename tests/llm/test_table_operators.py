import gzip
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_cases import awkward_documents, components_of, documents, prose

import corpus_pipeline
from colscope.llm import chats, common, decontaminate, forest, queries, stages, toxicity, warc


def test_components_of_chains_stars_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 150)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame([*links, (None, 3), (5, None)], "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == components_of(nodes, links)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def benchmark_items(spark, rows):
    return spark.createDataFrame([(i, t, 1.0) for i, t in rows], "item_id long, text string, score double")


def test_decontamination_against_brute_force(spark):
    items = [(i, f"{prose(400 + i, 14 + 7 * (i % 6))}. {prose(500 + i, 6)}") for i in range(20)] + [(60, None), (61, ""), (None, prose(1, 30)), (62, prose(2, 200)), (5, "x")]
    text = dict(items)
    whole = dict(items) | {5: f"{prose(405, 14 + 7 * 5)}. {prose(505, 6)}"}
    text[5] = max(whole[5], "x")
    rows = awkward_documents() + [(70 + i, f"{prose(600 + i, 300 * (i % 3))} {text[i].upper()} {prose(700 + i, 50)}") for i in range(20)]
    rows += [(95, text[3].split(".")[0]), (96, text[62]), (97, " ".join(text[8].split()[::-1])), (70, rows[0][1])]
    found = decontaminate.contaminated(documents(spark, rows), benchmark_items(spark, items)).collect()
    expected = set()
    for doc, t in rows:
        words = decontaminate.words_of(t or "")
        runs = {n: {tuple(words[i : i + n]) for i in range(len(words))} for n in (1, 5)}
        for item, it in text.items():
            sides = [decontaminate.runs_of(p) for p in decontaminate.parts_of(it or "") if p]
            if item is not None and sides and all(sum(r in runs.get(len(r), ()) for r in s) / len(s) >= 0.5 for s in sides):
                expected.add((doc, item))
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    assert decontaminate.contaminated(documents(spark, []), benchmark_items(spark, items)).count() == 0
    assert decontaminate.contaminated(documents(spark), benchmark_items(spark, [])).count() == 0


def test_wand_finds_all_items_above_the_threshold(spark):
    items = benchmark_items(spark, [(i, prose(i, 10 + i % 20)) for i in range(120)])
    for shard in (s for found in decontaminate.shards(items) for s in found):
        shard.seal()
        for seed in range(60):
            terms = sorted(random.Random(seed).sample(range(len(shard.postings)), min(len(shard.postings), 12)))
            scores = Counter()
            for t in terms:
                for i, v in shard.postings[t]:
                    scores[i] += v
            for least in (0.2, 0.5):
                assert {i for i, _ in decontaminate.wand(shard, terms, least)} == {i for i, v in scores.items() if v >= least - 1e-9}


def test_decontamination_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 600)
    items = [(i, prose(800 + i, 25)) for i in range(12)]
    found = decontaminate.contaminated(documents(spark, [(i, f"{prose(900 + i, 40)} {t}") for i, t in items]), benchmark_items(spark, items))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(12)}


def test_decontamination_looks_for_every_text_of_an_item_id(spark):
    items = [(i % 4, prose(1800 + i, 25)) for i in range(12)]
    found = decontaminate.contaminated(documents(spark, [(i, f"{prose(1900 + i, 40)} {t}") for i, (_, t) in enumerate(items)]), benchmark_items(spark, [*items, items[0]]))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i % 4) for i in range(12)]


def vectors():
    pick = np.random.default_rng(5)
    rows, center = [], pick.standard_normal(16)
    for i in range(120):
        rows.append((i, pick.standard_normal(16).tolist(), i % 3))
    for i in range(60):
        rows.append((200 + i, (center + 0.12 * pick.standard_normal(16)).tolist(), 1))
    rows += [(300 + i, center.tolist(), 1) for i in range(9)]
    rows += [(400, center.tolist(), 2), (401, None, 1), (402, [0.0] * 16, 1), (403, center.tolist(), None), (404, [None, *center[1:].tolist()], 1)]
    rows += [(405, [float("nan"), *center[1:].tolist()], 1), (406, [], 1), (407, center[:8].tolist(), 1), (408, (2 * center).tolist(), 1)]
    return rows


@pytest.mark.parametrize("leaf", [16, 1000])
def test_forest_against_brute_force(spark, leaf):
    rows = vectors()
    made = spark.createDataFrame([(*r, "x", 3) for r in [*rows, rows[0], (None, rows[0][1], 0)]], "vec_id long, embedding array<double>, label int, vector string, code int").repartition(3)
    found = forest.near_duplicates(made, leaf=leaf).collect()
    links = list(forest.brute_force([r for r in rows if r[1] is None or len(r[1]) == 16]))
    degree = Counter(x for pair in links for x in pair)
    at = components_of({r[0] for r in rows}, links)
    mine = {r.vec_id: r for r in found if r.vec_id is not None}
    assert len(found) == len(rows) + 1 and set(mine) == set(at)
    assert sum(r.n_links for r in mine.values()) >= 0.9 * 2 * len(links) and all(r.n_links <= degree[i] for i, r in mine.items())
    if leaf == 1000:
        assert {i: (r.n_links, r.component_id) for i, r in mine.items()} == {i: (degree[i], c) for i, c in at.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in mine.values())
    none = next(r for r in found if r.vec_id is None)
    assert (none.n_links, none.component_id, none.kept) == (0, None, None)


def test_forest_compares_unsplittable_leaves_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST_SPLITS", 0)
    rows = [r for r in vectors() if r[1] and len(r[1]) == 16]
    found = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=16).collect()
    links = list(forest.brute_force(rows))
    degree, at = Counter(x for pair in links for x in pair), components_of({r[0] for r in rows}, links)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (degree[i], c) for i, c in at.items()}
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def near_by_hand(rows):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    a, b = np.nonzero(np.triu((x @ x.T >= forest.LEAST_COSINE) & (labels[:, None] == labels), 1))
    return [(rows[i][0], rows[j][0]) for i, j in zip(a.tolist(), b.tolist())]


def test_forest_keeps_dense_groups_whole(spark):
    pick = np.random.default_rng(9)
    center = pick.standard_normal(64)
    rows = [(i, pick.standard_normal(64).tolist(), 0) for i in range(3000)]
    rows += [(5000 + i, (center + 0.22 * pick.standard_normal(64)).tolist(), 0) for i in range(3000)]
    found = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = near_by_hand(rows)
    degree, at = Counter(x for pair in links for x in pair), components_of({r[0] for r in rows}, links)
    assert len(links) > 3_000_000
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (degree[i], c) for i, c in at.items()}


@pytest.mark.parametrize("codes", [12, 30])
def test_forest_finds_groups_thin_in_every_cell(spark, codes):
    """The group's centre is at a right angle to the projections whose signs make the cells."""
    pick = np.random.default_rng(10)
    used = np.concatenate([forest.directions(t, 64) for t in range(3)])[:codes]
    center = pick.standard_normal(64)
    center -= used.T @ np.linalg.lstsq(used.T, center, rcond=None)[0]
    center *= 8 / np.linalg.norm(center)
    rows = [(i, pick.standard_normal(64).tolist(), 0) for i in range(10_000)]
    rows += [(50_000 + i, (center + 0.22 * pick.standard_normal(64)).tolist(), 0) for i in range(1500)]
    found = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = near_by_hand(rows)
    degree, at = Counter(x for pair in links for x in pair), components_of({r[0] for r in rows}, links)
    assert {r.vec_id: r.component_id for r in found} == at and all(r.n_links <= degree[r.vec_id] for r in found)
    recall = sum(r.n_links for r in found) / (2 * len(links))
    print("recall", recall)
    assert recall >= 0.99


def test_forest_does_not_deal_out_ties(spark):
    base = np.random.default_rng(4).standard_normal(64)
    made = spark.createDataFrame([(i, (base * (1 + i / 7)).tolist(), 1) for i in range(700)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in forest.near_duplicates(made).collect()} == {(699, 0)}
    points = spark.createDataFrame([(i, "1", 64, [1.0] * 72) for i in range(700)], "vec_id long, label string, size int, at array<double>")
    frames = common.Frames(spark)
    fallen = forest.leaves(points, forest.LEAF, forest.SPILL, frames).groupBy("tree", "node").count().collect()
    assert [(r.node, r["count"]) for r in fallen] == [(1, 700)] * forest.TREES
    frames.release()


def toxic_corpus(n=600):
    pick, rows, marks = random.Random(3), [], []
    for i in range(n):
        bad = i % 4 == 0
        extra = pick.sample(["vilestone", "vilester", "grimwort", "grimling"], 2) if bad else []
        rows.append((i, f"{prose(1000 + i, 30)} {' '.join(extra)} {prose(3000 + i, 5)}"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = toxic_corpus()
    labels = spark.createDataFrame([*marks, (3, 1, None), (None, 1, 1), marks[0]], "doc_id long, quality int, toxic int")
    more = [(9000, None), (9001, ""), (None, "grimwort vilester"), (9002, prose(1, 20_000)), rows[0]]
    found = toxicity.score_documents(documents(spark, rows + more), labels).collect()
    assert len(found) == len(rows) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    by = {r.doc_id: r for r in found}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows) and by[None].held_out is False
    held = [i for i, _, t in marks if by[i].held_out]
    truth = {i: t for i, _, t in marks}
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert by[9000].predicted == by[9001].predicted == by[9002].predicted == 0 and by[9000].score == by[9001].score
    assert toxicity.score_documents(documents(spark, []), labels).count() == 0


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    rows, marks = toxic_corpus(240)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in marks]
    scores = [
        {r.doc_id: r.score for r in toxicity.score_documents(documents(spark, rows), spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect()}
        for m in (marks, flipped)
    ]
    assert scores[0] == scores[1]


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_documents(documents(spark), empty).collect()} == {0}
    ones = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score_documents(documents(spark), ones).collect()) == len(awkward_documents())


def test_swap_cost_spares_neutral_mentions():
    """One group is mostly named in toxic sentences; the cost takes its name out of the score."""
    pick, texts, labels = random.Random(1), [], []
    for i in range(800):
        bad = i % 2 == 0
        group = "muslims" if pick.random() < (0.9 if bad else 0.1) else "jews"
        texts.append(f"{group} {'vermin' if bad and pick.random() < 0.8 else 'people'}")
        labels.append(int(bad))
    features = ["vermin", "people", *sorted({t for s in toxicity.IDENTITY_TERMS for t in s})]
    plain, fair = (toxicity.Scorer(toxicity.fit(texts, labels, features, swap_cost=c)) for c in (0.0, 10.0))
    gap = lambda m: m.score("muslims people") - m.score("jews people")
    assert gap(plain) > 0.2 and abs(gap(fair)) < gap(plain) / 4
    assert fair.score("muslims people") < plain.score("muslims people") and fair.score("jews vermin") > 0.5


def chats_by_hand(rows):
    logs = {}
    for conv, turn, role, text in sorted({(c, t, r or "", x or "") for c, t, r, x in rows if c is not None}, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], hashlib.md5(x[3].encode()).hexdigest())):
        logs.setdefault(conv, []).append(f"<|im_start|>{role}\n{text}<|im_end|>\n")
    best = {c: log for c, log in logs.items() if not any(o != c and b[: len(log)] == log and (len(b) > len(log) or o < c) for o, b in logs.items())}
    return {c: "".join(log) for c, log in best.items()}


def test_chats_against_brute_force(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t} {c if t > 3 and c % 2 else ''}") for c in range(12) for t in range(c + 1)]
    rows += [(30, t, "user", f"long {t}") for t in range(400)] + [(31, t, "user", f"long {t}") for t in range(300)] + [(32, t, "user", f"long {t}") for t in range(400)]
    rows += [(40, None, None, None), (41, 0, "user", "same"), (41, 0, "user", "same"), (41, 0, "user", "other"), (42, 0, "", ""), (None, 0, "user", "lost"), (43, 0, "a", prose(1, 9000))]
    made = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, number int, range int").repartition(5)
    found = chats.render_chats(made).collect()
    assert max(r.n_turns for r in found) <= chats.PART_TURNS
    text = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
    assert text == chats_by_hand(rows)
    assert chats.render_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def pages_by_hand(rows):
    out = Counter()
    for i, u, h in set(rows):
        body = (h or "").encode()
        twins = [(j is None, j or 0, j, v) for j, v, x in set(rows) if (x or "") == (h or "")]
        first = min((a, b, v or "", j) for a, b, j, v in twins)[3] if len(body) >= 100 else i
        again = first != i
        out[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    return out


def test_warc_against_brute_force(spark):
    tricky = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc é ☃ " + "x" * 100
    rows = [(i, f"http://h{i}.example.com/p?q={i}", f"<html>{prose(i % 4, 40)}</html>") for i in range(30)]
    rows += [(50, None, None), (51, "http://a/\r\nb", ""), (52, "x", tricky), (53, "y", tricky), (54, "z", "short"), (55, "z", "short"), (None, "u", tricky), (56, "w", prose(9, 100_000)), rows[3]]
    made = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, kind int").repartition(4)
    captures = warc.archive_pages(made)
    assert Counter(tuple(r) for r in warc.page_digest(captures).collect()) == pages_by_hand(rows)
    one = captures.where("metadata.page_id = 52").first()
    assert bytes(one.response.payload).decode() == tricky and one.request.line == "GET /x HTTP/1.1"
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_keeps_every_row(spark, monkeypatch, tmp_path):
    """The contract's rows, in SQL, on a table of rows that repeat in one, two or three columns."""
    monkeypatch.setattr(warc, "REPEATS", 4)
    monkeypatch.setattr(warc, "FILE_PAGES", ((120, 5), (400, 2)))
    rows = [(1, "a", "x" * 100)] * 3 + [(1, "b", "x" * 100), (2, "c", "x" * 100), (2, "c", "x" * 100), (3, "d", "short"), (3, "d", "short"), (3, "e", "short"), (4, None, None), (4, "", ""), (1, "a", "y" * 300)]
    rows += [(9, "hot", prose(3, 40))] * 15 + [(8, "hot", prose(3, 40)), (7, "long", prose(4, 5000))]
    made = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    captures = warc.archive_pages(made, every_row=True)
    path = str(tmp_path / "pages.parquet")
    pandas = made.toPandas()
    pandas.to_parquet(path)
    expected = duckdb.sql(queries.ORACLE["op9_warc"].replace("from pages", f"from '{path}'")).fetchall()
    assert Counter(tuple(r) for r in warc.page_digest(captures).collect()) == Counter(expected)
    assert captures.where("response is null or request is null or metadata is null").count() == 0
    named = {r.refers_to for r in captures.where("response.kind = 'revisit'").select("response.refers_to").collect()}
    assert named <= {r.id for r in captures.where("response.kind = 'response'").select("response.id").collect()}


def test_warc_reads_members_and_plain_files():
    record = lambda n: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % n + b"z" * n + b"\r\n\r\n"
    plain = record(0) + record(5) + record(3_000_000)
    members = gzip.compress(record(0)) + gzip.compress(record(5)) + gzip.compress(record(3_000_000))
    for content in (plain, gzip.compress(plain), members):
        assert [len(b) for _, b in warc.parsed(warc.unpacked(content))] == [0, 5, 3_000_000]
    with pytest.raises(ValueError):
        list(warc.parsed(iter([plain[:-100]])))


def test_stages_keep_columns_and_clean_documents(spark):
    rows, marks = toxic_corpus(200)
    copied = [(5000 + i, rows[4 * i + 1][1] + " more") for i in range(5)]
    item = prose(77, 40)
    docs = documents(spark, rows + copied + [(6000, f"{prose(78, 30)} {item}"), (6001, None), (6002, "")])
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = stages.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and ids(clean) == ids(docs) - {i for i, _, t in marks if t}
    fewer = stages.drop_repeated_lines(docs)
    assert fewer.columns == docs.columns and ids(fewer) == ids(docs)
    single = stages.drop_near_copies(docs)
    assert single.columns == docs.columns and ids(single) == ids(docs) - {5000 + i for i in range(5)}
    apart = stages.drop_contaminated(docs, benchmark_items(spark, [(1, item)]))
    assert apart.columns == docs.columns and ids(apart) == ids(docs) - {6000}
    empty = documents(spark, [])
    assert all(df.count() == 0 for df in (stages.drop_toxic(empty, labels), stages.drop_repeated_lines(empty), stages.drop_near_copies(empty), stages.drop_contaminated(empty, benchmark_items(spark, []))))


def test_pipeline_runs_its_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    docs = queries.read(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    sort = lambda df: sorted(df.select("doc_id", "n_tokens").collect())
    assert sort(docs) == sort(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))
