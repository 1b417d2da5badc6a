import math

import numpy as np
import pytest

from colscope.operators import profile
from colscope.operators.distinct import approximate_distinct, exact_distinct
from colscope.operators.profile import profile_columns
from colscope.operators.quantiles import exact_quantiles, values_at_ranks
from colscope.sources.tables import schema_summary

NAN, INF = float("nan"), float("inf")


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_gaps_infinities_and_constants(spark):
    rows = [
        (1.0, NAN, 7.0, None, "a", True),
        (2.0, INF, 7.0, None, "b", False),
        (3.0, -INF, 7.0, None, "b", None),
        (4.0, 0.0, 7.0, None, None, True),
        (None, -5.0, 7.0, 9.0, "a", True),
    ]
    df = spark.createDataFrame(rows, "a double, wild double, flat double, lone double, s string, b boolean")
    p = by_column(profile_columns(df))
    assert (p["a"]["q1"], p["a"]["median"], p["a"]["q3"]) == (1.75, 2.5, 3.25)
    assert p["a"]["distinct"] == 5 and p["a"]["null_pct"] == pytest.approx(20.0)
    assert p["wild"]["finite"] == 2 and p["wild"]["mean"] is None and p["wild"]["std"] is None
    # sorted: -inf, -5, 0, inf, nan
    assert p["wild"]["median"] == 0.0
    assert (p["wild"]["min"], p["wild"]["max"], p["wild"]["negatives"], p["wild"]["zeros"]) == (-5.0, 0.0, 1, 1)
    assert p["wild"]["q1"] is None and p["wild"]["outliers_iqr"] is None
    assert p["flat"]["std"] == 0.0 and p["flat"]["skewness"] is None and p["flat"]["outliers_z"] == 0
    assert p["lone"]["std"] is None and p["lone"]["median"] == 9.0 and p["lone"]["distinct"] == 2
    assert p["s"]["analytic_type"] == "categorical" and p["s"]["distinct"] == 3 and p["s"]["chart"] == "bars"
    assert p["b"]["analytic_type"] == "boolean" and p["b"]["chart"] == "bars"


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    p = by_column(profile_columns(df))
    assert p["x"]["rows"] == 0 and p["x"]["null_pct"] == 0.0 and p["x"]["distinct_pct"] == 0.0
    assert p["x"]["mean"] is None and p["s"]["analytic_type"] == "categorical"


def test_nested_and_odd_names(spark):
    df = spark.createDataFrame(
        [(1, [1.0], {"k": 1}, "x" * 100), (2, [1.0], {"k": 2}, "x" * 100), (3, [2.0], {"k": 3}, "x" * 99 + "y")],
        "`a.b` int, arr array<double>, m map<string,int>, long_text string",
    )
    p = by_column(profile_columns(df))
    assert p["a.b"]["mean"] == 2.0
    assert p["arr"]["distinct"] == 2 and p["long_text"]["distinct"] == 2
    assert p["m"]["distinct"] is None and p["m"]["analytic_type"] == "text_id"
    assert p["m"]["chart"] == "skip_possible_id"


def test_shape_matches_numpy(spark):
    x = np.random.default_rng(1).gamma(2.0, 3.0, 3000)
    p = by_column(profile_columns(spark.createDataFrame([(float(v),) for v in x], "x double")))["x"]
    z = (x - x.mean()) / x.std()
    assert p["skewness"] == pytest.approx((z**3).mean())
    assert p["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert p["outliers_z"] == int((abs(z) >= 3).sum())
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert p["outliers_iqr"] == int(((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum())


@pytest.mark.parametrize("shape", ["plain", "hot", "copies"])
def test_rank_search_is_exact(spark, shape):
    rng = np.random.default_rng(2)
    x = rng.lognormal(0, 3, 6000)
    if shape == "hot":
        x[: len(x) // 2] = 1.5
    if shape == "copies":
        x = np.round(x)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0]
    found = exact_quantiles(df, {"x": ps}, {"x": len(x)}, small=200, sample=300)
    for p in ps:
        assert found[("x", p)] == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_ranks_of_other_types(spark):
    words = [f"w{i:04d}" for i in range(900)]
    df = spark.createDataFrame([(w,) for w in reversed(words)], "w string")
    found = values_at_ranks(df, [("w", 0), ("w", 450), ("w", 899)], {"w": 900}, small=50, sample=100)
    assert found == {("w", 0): "w0000", ("w", 450): "w0450", ("w", 899): "w0899"}


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(2000).selectExpr("(id * 7919) % 1000 / 3 as x", "concat('k', id % 61) as s")
    one, many = profile_columns(df.repartition(1)).collect(), profile_columns(df.repartition(8)).collect()
    for a, b in zip(one, many):
        for u, v in zip(a, b):
            assert u == v or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-12)


def test_distinct_counts(spark):
    df = spark.range(5000).selectExpr(
        "cast(id % 50 as int) as fifty", "id", "if(id % 3 = 0, null, id % 7) as gaps",
        "if(id % 2 = 0, 0.0D, -0.0D) as zeros", "9007199254740993 + id % 2 as big",
    )
    assert exact_distinct(df, df.columns) == {"fifty": 50, "id": 5000, "gaps": 7, "zeros": 1, "big": 2}
    close = approximate_distinct(df, df.columns, 5000)
    assert close["fifty"] == 50 and close["id"] == 5000 and close["big"] == 2


def test_schema_summary(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in schema_summary(df).collect()] == [(0, "a", "int", 0, 2), (1, "b", "string", 1, 2)]


def test_columns_of_very_many_values_are_searched_not_sorted(spark, monkeypatch):
    df = spark.range(4_000).selectExpr("id * 7 % 4001 as many", "cast(id % 30 as double) as few", "if(id % 9 = 0, null, sqrt(id)) as gaps")
    plain = {r["column"]: r for r in profile.profile_columns(df).collect()}
    asked, at_ranks = set(), profile.ValueCounts.at_ranks
    monkeypatch.setattr(profile.ValueCounts, "at_ranks", lambda self, ranks, *a: asked.update(ranks) or at_ranks(self, ranks, *a))
    monkeypatch.setattr(profile, "IN_ONE_TASK", 100)
    searched = {r["column"]: r for r in profile.profile_columns(df, small=200, sample=500).collect()}
    assert asked == {"few"} and searched == plain
