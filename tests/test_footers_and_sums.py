import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colscope.operators import clustering, profile, quantiles, sums, value_counts
from colscope.plans import sinks
from colscope.sources import footers


def facts(df):
    return [tuple(r) for r in df.collect()]


def table(path, **options):
    made = pa.table({"a": pa.array([3, None, -5], pa.int32()), "b.c": ["x", None, None], "d": [1.5, 2.5, float("nan")], "l": [[1], None, []], "n": pa.array([None] * 3, pa.int64())})
    pq.write_table(made, path, **options)
    return [(0, "a", "int", 1, 3, -5, 3), (1, "b.c", "string", 2, 3, None, None), (2, "d", "double", 0, 3, None, None), (3, "l", "array<bigint>", 1, 3, None, None), (4, "n", "bigint", 3, 3, None, None)]


def test_facts_come_from_footers(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    expected = table(path)
    assert facts(footers.table_facts(spark, path)) == expected
    df = footers.footer_session(spark).read.parquet(path)
    assert footers.pushed_aggregation(footers.row_counts(df, ["a", "b.c", "d", "n"])) and footers.pushed_aggregation(footers.ranges(df, [0]))
    assert not footers.pushed_aggregation(footers.row_counts(spark.read.parquet(path), ["a"]))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_facts_without_statistics_are_scanned(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    expected = table(path, write_statistics=False)
    assert facts(footers.table_facts(spark, path)) == expected


def test_facts_of_several_files_and_partition_columns(spark, tmp_path):
    path = f"{tmp_path}/parts"
    spark.createDataFrame([(i, i % 3, f"t{i}" if i % 2 else None) for i in range(20)], "k long, p int, t string").repartition(4).write.partitionBy("p").parquet(path)
    assert sorted(facts(footers.table_facts(spark, path))) == [(0, "k", "bigint", 0, 20, 0, 19), (1, "t", "string", 10, 20, None, None), (2, "p", "int", 0, 20, 0, 2)]
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], "k long, t string").write.parquet(empty)
    assert facts(footers.table_facts(spark, empty)) == [(0, "k", "bigint", 0, 0, None, None), (1, "t", "string", 0, 0, None, None)]


def exact(values):
    mean = sum(map(Fraction, values)) / len(values)
    return float(mean), float(sum((Fraction(v) - mean) ** 2 for v in values) / len(values))


def moments(spark, values, parts):
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(parts)
    return sums.exact_moments(frame, {"x": (len(values), exact_mean(values), min(values), max(values))})["x"]


CASES = {
    "cents": [round(0.01 * (i % 9), 2) for i in range(3000)],
    "far from zero": [1e15 + i % 7 for i in range(2000)],
    "cancelling": [1e16, 1.0, -1e16] * 300,
    "wide": [10.0 ** (i % 20 - 10) * (-1) ** i for i in range(2000)],
    "huge": [1.7e308 if i % 2 else 1.5e308 for i in range(100)],
    "tiny": [5e-324 * (i % 5) for i in range(100)],
    "negative": [-0.1 * i for i in range(1000)],
    "constant": [0.1] * 700,
    "two": [0.1, 0.3],
}


@pytest.mark.parametrize("name", CASES)
def test_moments_against_exact_fractions(spark, name):
    values = CASES[name]
    found = moments(spark, values, 3)
    if name == "huge":
        assert found.mean == exact_mean(values) and found.variance == math.inf
        return
    mean, variance = exact(values)
    assert found.mean == mean or name == "tiny" and abs(found.mean - mean) <= 5e-324
    assert math.isclose(found.variance, variance, rel_tol=1e-12, abs_tol=1e-300)
    assert found == moments(spark, values[::-1], 7)


def exact_mean(values):
    return float(sum(map(Fraction, values)) / len(values))


def test_profile_means_do_not_hang_on_partitions(spark):
    values = [(round(0.01 * (i * 7919 % 100), 2), i / 3) for i in range(5000)]
    frames = [spark.createDataFrame(rows, "a double, b double").repartition(parts) for rows, parts in ((values, 1), (values[::-1], 5))]
    one, two = (profile.profile_columns(f).select("column", "mean", "std", "finite_std").collect() for f in frames)
    assert one == two and one[0].mean == exact_mean([a for a, _ in values])


def counted_frame(spark):
    pick = random.Random(3)
    rows = [(pick.randrange(40), pick.gauss(0, 1), pick.choice([0.0, -0.0, math.nan, math.inf, -math.inf, 2.5, None]), 2**60 + i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "a int, b double, c double, d long").repartition(5)


@pytest.mark.parametrize("small", [10, 100_000])
def test_value_counts_give_distinct_counts_and_ranks(spark, small):
    rows, df = counted_frame(spark)
    counts = value_counts.value_counts(df, df.columns)
    assert counts.distinct == {"a": 40, "b": 3000, "c": 5, "d": 3000}
    for j, n in enumerate(df.columns):
        ordered = sorted(float(r[j]) for r in rows if r[j] is not None and math.isfinite(r[j]))
        ranks = [0, 1, len(ordered) // 3, len(ordered) - 1]
        assert counts.at_ranks({n: ranks}, small) == {(n, r): ordered[r] for r in ranks}
        found = counts.quantiles({n: [0.0, 0.31, 0.5, 1.0]}, {n: len(ordered)}, small)
        assert all(math.isclose(v, np.quantile(ordered, p), rel_tol=1e-12, abs_tol=1e-12) for (_, p), v in found.items())
    counts.release()


def test_value_counts_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "a int, b double")
    counts = value_counts.value_counts(df, ["a", "b"])
    assert counts.distinct == {"a": 0, "b": 0} and counts.quantiles({"a": [0.5]}, {"a": 0}) == {}


@pytest.mark.parametrize("error", [0.05, 0.0005])
def test_sketched_ranks_lie_within_the_error(spark, error):
    rows, df = counted_frame(spark)
    frame = df.selectExpr("a", "b", "cast(null as double) e")
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.sketch_quantiles(frame, {n: ps for n in frame.columns}, error)
    assert {n for n, _ in found} == {"a", "b"}
    for j, n in enumerate(("a", "b")):
        ordered = sorted(r[j] for r in rows)
        for p in ps:
            v = found[(n, p)]
            below, upto = sum(x < v for x in ordered), sum(x <= v for x in ordered)
            off = max(below - p * len(ordered), p * len(ordered) - upto, 0) / len(ordered)
            assert off <= error and v in ordered
            assert quantiles.rank_distances(frame, {(n, p): v})[(n, p)] == off
    assert quantiles.sketch_quantiles(frame, {}) == {}
    with pytest.raises(ValueError):
        quantiles.sketch_quantiles(frame, {"a": ps}, 0)


def test_farthest_rows_need_no_sort_of_the_table(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 50)) for i in range(400)], "k long, distance double").repartition(6)
    marked = clustering.odd_marked(df, 25.0, 10.0, 30.0)
    some, every = clustering.farthest_rows(marked, ["k"], 20), clustering.farthest_rows(marked, ["k"], None)
    plan = some._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    columns = ["k", "distance", "z_score", "_place"]
    assert sorted(map(tuple, some.select(columns).collect())) == sorted(tuple(r) for r in every.select(columns).collect() if r._place < 20)


@pytest.mark.parametrize("single", [True, False])
def test_csv_cells_come_back(spark, tmp_path, single):
    cells = ["plain", "a,b", 'say "so"', "two\nlines", ' " ', "", None, "  blanks  ", "\\", '\\"', "é☃", ",", '"', '""', "#x", "tab\there", "\n"]
    rows = [(i, c, str(c)[::-1]) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "`a.b` long, c string, d string").repartition(3)
    sinks.write_csv(df, f"{tmp_path}/x.csv", single)
    back = sinks.read_csv(spark, f"{tmp_path}/x.csv")
    assert back.columns == df.columns
    assert sorted(tuple(r) for r in back.collect()) == sorted((str(i), c or "", d) for i, c, d in rows)
