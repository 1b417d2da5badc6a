import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.functions import scalars as S
from colscope.operators import advice, correlation, groups, insights, selection
from colscope.operators.profile import PROFILE_COLUMNS, profile_columns
from colscope.session import local_rows

NAN = float("nan")


def value(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_pairs_with_gaps(spark):
    rows = [(1.0, 1.0, None), (2.0, 1.0, 5.0), (3.0, 2.0, 5.0), (NAN, 9.0, 5.0), (7.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for method in ("pairs", "matrix"):
        r = {(x["column_1"], x["column_2"]): x["r"] for x in correlation.pairwise_pearson(df, method=method).collect()}
        assert r[("a", "b")] == pytest.approx(0.866025, abs=1e-6)
        assert r[("a", "c")] == pytest.approx(-0.981981, abs=1e-6)
        assert r[("b", "c")] is None


def test_matrix_and_pairs_agree(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 6)) * [1, 1e6, 1e-3, 1, 1, 1] + [0, 1e9, 0, 5, 0, 0.1]
    base[:, 5] = 0.1
    rows = [tuple(None if rng.random() < 0.2 and j < 3 else float(v) for j, v in enumerate(r)) for r in base]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(6))).repartition(3)
    a = {(x["i"], x["j"]): x["r"] for x in correlation.pairwise_pearson(df, method="pairs").collect()}
    b = {(x["i"], x["j"]): x["r"] for x in correlation.pairwise_pearson(df, method="matrix").collect()}
    assert a.keys() == b.keys() and len(a) == 15
    for k in a:
        assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], abs=1e-9)
    assert all(a[k] is None for k in a if 5 in k)


def strong_of(spark, triples):
    rows = [(n, 0, n, a, b, r, abs(r), "") for n, (a, b, r) in enumerate(triples, 1)]
    return local_rows(spark, rows, "rank int, i int, j int, column_1 string, column_2 string, r double, abs_r double, strength string")


def test_groups_of_a_chain(spark):
    strong = strong_of(spark, [("b", "c", 0.9), ("a", "b", -0.8), ("d", "e", 0.75)])
    found = groups.column_groups(strong).collect()
    assert len(found) == 1
    g = found[0]
    assert (g["columns"], g["size"]) == (["a", "b", "c"], 3)
    assert (g["mean_abs_r"], g["min_abs_r"]) == (pytest.approx(0.85), 0.8)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = {(f"n{a:02d}", f"n{b:02d}") for a, b in rng.integers(0, 40, (30, 2)) if a < b}
    edges |= {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)}
    labels = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            labels[a] = labels[b] = min(labels[a], labels[b])
    df = local_rows(spark, sorted(edges), "a string, b string")
    assert {r["node"]: r["label"] for r in groups.component_labels(df).collect()} == labels


def fake_profile(spark, **columns):
    base = {
        "physical_type": "double", "analytic_type": "numeric", "rows": 1000, "non_null": 1000, "nulls": 0,
        "null_pct": 0.0, "distinct": 500, "distinct_pct": 50.0, "mean": 1.0, "std": 1.0, "outliers_iqr": 0,
        "outliers_z": 0, "zeros": 0, "negatives": 0, "chart": "x", "finite": 1000,
    }
    whole = {"rows", "non_null", "nulls", "distinct", "outliers_iqr", "outliers_z", "zeros", "negatives", "finite"}
    text = {"column", "physical_type", "analytic_type", "chart"}
    names = ["ordinal", *PROFILE_COLUMNS, "finite", "finite_mean", "finite_std"]
    kinds = ["int" if n == "ordinal" else "string" if n in text else "bigint" if n in whole else "double" for n in names]
    rows = []
    for i, (name, changes) in enumerate(columns.items()):
        full = {**base, **changes, "column": changes.get("column", name), "ordinal": i}
        rows.append(tuple(full.get(n) for n in names))
    return local_rows(spark, rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def test_scores(spark):
    p = fake_profile(
        spark,
        clean={},
        nulls40={"null_pct": 40.0},
        nulls70={"null_pct": 70.0},
        nulls95={"null_pct": 95.0},
        constant={"distinct": 1},
        two={"distinct": 2},
        order_id={"distinct_pct": 70.0},
        humidity={"distinct_pct": 99.0},
        precio={"distinct_pct": 99.0},
        memo={"analytic_type": "text_id", "distinct_pct": 80.0},
        words={"analytic_type": "text_id", "distinct_pct": 60.0},
        many={"analytic_type": "categorical", "distinct": 1001, "distinct_pct": 10.0},
        flat={"std": 0.0},
        spiky={"outliers_iqr": 1},
        when={"analytic_type": "temporal", "std": None},
        empty={"non_null": 0},
        unknown={"analytic_type": "text_id", "distinct": None, "distinct_pct": None},
        null70_id={"column": "uuid", "null_pct": 70.0, "distinct_pct": 90.0},
    )
    got = {r["column"]: (round(r["score"], 9), r["risk"]) for r in selection.column_score(p).collect()}
    assert got == {
        "clean": (1.0, "low"), "nulls40": (0.75, "medium"), "nulls70": (0.45, "high"), "nulls95": (0.0, "high"),
        "constant": (0.0, "high"), "two": (0.75, "medium"), "order_id": (0.45, "medium"),
        "humidity": (0.45, "medium"), "precio": (1.0, "low"), "memo": (0.55, "medium"), "words": (0.8, "low"),
        "many": (0.7, "medium"), "flat": (0.0, "high"), "spiky": (0.97, "low"), "when": (0.95, "low"),
        "empty": (0.0, "high"), "unknown": (0.0, "high"), "uuid": (0.0, "medium"),
    }


def test_redundant_end_and_decisions(spark):
    p = fake_profile(spark, a={}, b={}, c={"outliers_iqr": 3}, memo={"analytic_type": "text_id", "distinct_pct": 90.0})
    strong = strong_of(spark, [("a", "b", 1.0), ("b", "c", 0.98), ("a", "c", 0.979)])
    got = {r["column"]: r for r in selection.feature_selection(p, strong).collect()}
    assert got["b"]["repeats"] == "a" and got["b"]["decision"] == "review" and got["b"]["score"] == pytest.approx(0.54)
    assert got["c"]["repeats"] == "b" and got["a"]["repeats"] is None and got["a"]["decision"] == "use"
    assert got["memo"]["decision"] == "use" and got["memo"]["score"] == pytest.approx(0.55)
    assert got["c"]["correlated_with"] == "b" and got["c"]["max_correlation"] == 0.98
    summary = selection.selection_summary(selection.feature_selection(p, strong), ["b", "a", "b"]).first()
    assert summary["n_use"] + summary["n_review"] + summary["n_drop"] == summary["columns"] == 4
    assert summary["used_columns"] == ["a", "b"]


def test_fallback_to_all_numeric_columns(spark):
    p = fake_profile(spark, a={}, flat={"std": 0.0}, s={"analytic_type": "categorical"})
    assert selection.analysis_columns(p) == ["a", "flat"]
    assert selection.analysis_columns(p, apply_selection=False) == ["a", "flat"]


def test_insight_order(spark):
    p = fake_profile(
        spark, gaps={"null_pct": 60.0}, some={"null_pct": 20.0, "distinct": 1, "distinct_pct": 96.0},
        out={"outliers_iqr": 50, "skewness": -2.0},
    )
    chosen = selection.feature_selection(p)
    found = insights.insights(p, selection=chosen, summary=selection.selection_summary(chosen)).orderBy("rank").collect()
    assert [(r["category"], r["severity"], r["subject"]) for r in found] == [
        ("quality", "high", "gaps"), ("quality", "medium", "some"), ("variability", "medium", "some"),
        ("outliers", "medium", "out"), ("identifier", "low", "some"), ("distribution", "low", "out"),
        ("feature_selection", "low", "all columns"), ("feature_selection", "high", "some"),
    ]


def test_usefulness(spark):
    p = fake_profile(spark, a={}, key={"distinct_pct": 95.0}, c={"analytic_type": "categorical", "distinct": 50},
                     k={"distinct": 1}, u={"analytic_type": "text_id", "distinct": None, "distinct_pct": None})
    got = {r["column"]: round(r["score"], 9) for r in advice.ml_scores(p).collect()}
    assert got == {"a": 1.0, "key": 0.35, "c": 0.9125, "k": 0.65, "u": 0.7725}
    warned = advice.ml_scores(p, spark.range(1), "nothing", ["a"]).collect()
    assert len(warned) == 6 and warned[-1]["advice"] == "target_unusable"


def test_scalar_functions(spark):
    assert value(spark, S.correlation_strength(F.lit(-0.9))) == "very_strong_negative"
    assert value(spark, S.correlation_strength(F.lit(0.0))) == "very_low_none"
    ks = {29: 2, 59: 2, 60: 3, 299: 3, 300: 4, 2999: 4, 3000: 5, 20000: 6}
    assert {n: value(spark, S.cluster_count(F.lit(n))) for n in ks} == ks
    assert value(spark, S.html_text(F.lit("<&>'\""))) == "&lt;&amp;&gt;&#39;&quot;"
    assert value(spark, S.fixed_decimals(F.lit(NAN), 3)) == "" and value(spark, S.fixed_decimals(F.lit(1.5), 3)) == "1.500"
    assert value(spark, S.abbreviate(F.lit("abcdef"), 4)) == "abc…"
    names = {"humidity": True, "codigo": True, "cod_x": True, "precio": False, "code": True}
    assert {n: value(spark, S.looks_like_id(F.lit(n))) for n in names} == names
    assert value(spark, S.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert value(spark, S.zscore(F.lit(None).cast("double"), 1.0, 2.0)) == 0.0
    assert value(spark, S.relative_range(F.lit(1.0), F.lit(0.0), F.lit(3.0))) == 2.0
    assert value(spark, S.variation_coefficient(F.lit(2.0), F.lit(0.0))) == 2.0


def test_correlation_is_scale_free(spark):
    df = spark.range(300).selectExpr("id % 17 as a", "(id * id) % 23 as b", "3.5 * (id % 17) + 2 as c")
    r = {(x["column_1"], x["column_2"]): x["r"] for x in correlation.pairwise_pearson(df.selectExpr("a", "b", "cast(c as double) c")).collect()}
    assert r[("a", "c")] == pytest.approx(1.0) and r[("a", "b")] == pytest.approx(r[("b", "c")])
    assert all(abs(v) <= 1 for v in r.values())
    assert len(list(itertools.combinations("abc", 2))) == len(r)


def test_profile_feeds_selection(spark):
    df = spark.range(200).selectExpr("id as order_id", "id % 9 as x", "'k' as s")
    got = {r["column"]: r["decision"] for r in selection.feature_selection(profile_columns(df)).collect()}
    assert got == {"order_id": "review", "x": "use", "s": "drop"}
