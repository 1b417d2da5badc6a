"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

import random

WORDS = [a + b for a in "ka lo mi ru te za xo".split() for b in "na ri so tu ve".split()]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


def awkward_documents():
    long = prose(1, 20_000)
    base = prose(2, 120).split()
    near = list(base)
    near[60] = "changed"
    line = "this very line is common to many of these documents, is it not?"
    rows = [(0, None), (1, ""), (2, "one two"), (3, "  "), (4, long), (5, long + " end"), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(base)), (8, " ".join(base)), (None, " ".join(base)), (None, None)]
    rows += [(20 + i, f"{prose(30 + i, 12)}\n  {line.upper() if i % 2 else line}\t\n\n{prose(50 + i, 9)}") for i in range(7)]
    rows += [(40, f"{line}\n{line}"), (41, "é" * 45 + "\nñandú ☃ 𝄞"), (42, "One Two"), (43, "a\nb"), (43, "a\nc")]
    return rows


def documents(spark, rows=None):
    rows = awkward_documents() if rows is None else rows
    # the further columns bear names that operators use inside
    made = [(i, t, "en", "src", len(t or ""), 1, "k", 2.0) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, pos int, key string, score double").repartition(3)


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}
