import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.compare import difference
from checks.oracle import ORACLE
from checks.queries import QUERIES
from colscope.operators import bootstrap, clustering, ordering
from colscope.operators.distinct import exact_distinct
from colscope.operators.profile import profile_columns


def test_systematic_sample(spark):
    df = spark.range(10).selectExpr("9 - id as id")
    got = ordering.systematic_sample(df, ["id"], 4).orderBy("position").collect()
    assert [r["position"] for r in got] == [0, 3, 6, 9] and [r["id"] for r in got] == [0, 3, 6, 9]
    assert [r["approx_row_number"] for r in got] == [1, 4, 7, 10]
    assert ordering.systematic_sample(df, ["id"], 10, unique=True).count() == 10


def test_sample_with_a_heap_of_copies(spark):
    df = spark.range(3000).selectExpr("if(id < 1500, 5, id % 10) as k")
    got = ordering.systematic_sample(df, ["k"], 100).orderBy("position").collect()
    expected = sorted(5 if i < 1500 else i % 10 for i in range(3000))[::30]
    assert [r["k"] for r in got] == expected


def test_running_index_in_groups(spark):
    rng = np.random.default_rng(0)
    group = np.where(rng.random(2000) < 0.4, 3, rng.integers(0, 50, 2000))
    pdf = pd.DataFrame({"g": group, "o": rng.permutation(2000), "w": rng.integers(1, 9, 2000)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = ordering.running_index(df, ["o"], weight="w", group=["g"]).toPandas().sort_values(["g", "o"])
    before = got.groupby("g")["w"].cumsum() - got["w"]
    assert (before.values == got["start"].values).all() and len(got) == 2000


def test_running_index_rejects_group_types_that_compare_differently(spark):
    with pytest.raises(ValueError):
        ordering.running_index(spark.createDataFrame([(1.0, 1)], "g double, o int"), ["o"], group=["g"])


def test_rows_at_positions_with_ties(spark):
    rows = [(i % 3, None if i % 7 == 0 else i, f"r{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "a int, b int, name string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0], (r[1] is not None, r[1] or 0)))
    wanted = [p for p in range(90) if order[p][1] is not None][::11]
    got = ordering.rows_at_positions(df, ["a", "b"], wanted, small=5, sample=20)
    assert {p: r["name"] for p, r in got.items()} == {p: order[p][2] for p in wanted}
    nulls = ordering.rows_at_positions(df, ["a", "b"], [0])[0]
    assert nulls["a"] == 0 and nulls["b"] is None


def spread(result):
    """The sum of squared distances of the rows to their centres."""
    return result.assignments.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]


def test_clusters_from_estimated_centres(spark):
    """Blobs in key order: all seeds by position but one lie in the large first blob, k-means|| finds the others."""
    rng = np.random.default_rng(3)
    sizes, centres = [1000, 30, 30, 30, 30], [(0, 0), (9, 9), (9, -9), (-9, 9), (-9, -9)]
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c, n in zip(centres, sizes)]).round(1)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    profile = profile_columns(df)
    plain = clustering.cluster_rows(df, profile, ["id"], ["a", "b"])
    found = clustering.cluster_rows(df, profile, ["id"], ["a", "b"], method="ml")
    assert found.applied and sum(found.sizes) == len(x) and len(found.centroids) <= len(plain.centroids)
    assert found.summary.first()["converged"] and spread(found) <= spread(plain)
    with pytest.raises(ValueError):
        clustering.cluster_rows(df, profile, ["id"], ["a", "b"], method="other")


def test_a_poor_draw_of_the_estimator_is_not_kept(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.2, (20, 2)) for m in (0, 5, 10, 15)]).round(2)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    monkeypatch.setattr(clustering, "_estimated", lambda rows, zs, k, max_rounds: [[50.0 + i, 50.0] for i in range(k)])
    profile = profile_columns(df)
    plain, found = (clustering.cluster_rows(df, profile, ["id"], ["a", "b"], method=m) for m in ("positions", "ml"))
    assert spread(found) == pytest.approx(spread(plain))


def lloyd(x, k, rounds=35):
    n = len(x)
    seeds = x[[min(int((i + 0.5) * n / k), n - 1) for i in range(k)]]
    centres, labels = seeds.copy(), np.zeros(n, dtype=int)
    for _ in range(rounds):
        new = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        moved = (new != labels).any()
        labels = new
        centres = np.array([x[labels == i].mean(0) if (labels == i).any() else seeds[i] for i in range(k)]).round(12)
        if not moved:
            break
    return labels, np.sqrt(((x - centres[labels]) ** 2).sum(1)), centres


def test_clusters_match_numpy(spark):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(m, 1.0, (400, 3)) for m in (0, 4, 9, -6)])
    rng.shuffle(data)
    data = np.round(data, 1)
    pdf = pd.DataFrame(data, columns=list("abc")).assign(key=range(len(data)))
    pdf.loc[5, "a"] = None
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None))).repartition(6)
    result = clustering.cluster_rows(df, profile_columns(df), ["key"], ["a", "b", "c"])
    cols = result.features
    x = pdf[cols]
    z = ((x - x.mean()) / x.std(ddof=0)).clip(-8, 8).fillna(0).to_numpy()
    labels, d, _ = lloyd(z, 4)
    got = result.assignments.toPandas().sort_values("key")
    assert (got["cluster"].values == labels).all()
    assert np.allclose(got["distance"].values, d)
    summary = result.summary.first()
    assert summary["p95_distance"] == pytest.approx(np.quantile(d, 0.95))
    assert summary["std_distance"] == pytest.approx(d.std())
    odd = result.odd_rows.orderBy("rank").collect()
    limit = max(0, np.quantile(d, 0.95))
    flagged = (d >= limit) | ((d - d.mean()) / d.std() >= 2.5)
    assert len(odd) == min(200, flagged.sum())
    assert [r["key"] for r in odd][:10] == list(np.argsort(-d, kind="stable")[:10])
    assert sum(r["size"] for r in result.clusters.collect()) == len(data)
    assert odd[0]["explanation"].count("σ") == 3


def test_clustering_gates(spark):
    df = spark.range(29).selectExpr("id", "(id * 7) % 11 as a", "(id * 5) % 13 as b")
    result = clustering.cluster_rows(df, profile_columns(df), ["id"])
    assert not result.applied and result.clusters.count() == 0 and result.odd_rows.count() == 0
    df = spark.range(30).selectExpr("(id * 7) % 11 as a", "'x' as b", "id")
    assert not clustering.cluster_rows(df, profile_columns(df), ["id"], ["a"]).applied


def test_bootstrap_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.gamma(1.0, 5.0, 700), 1)
    x[:250] = 2.5
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, 1.0)], "amount double, other double").repartition(5)
    result = bootstrap.bootstrap(df, profile_columns(df), names=["amount"], simulations=40, batch=30)
    s = np.sort(x)
    picks = [int(hashlib.md5(f"amount|{i}".encode()).hexdigest()[:15], 16) % 700 for i in range(40 * 30)]
    drawn = s[picks].reshape(40, 30)
    row = result.summary.first()
    for name, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)):
        assert row[f"sim_mean_{p and name}"] == pytest.approx(np.quantile(drawn.mean(1), p))
        assert row[f"hist_{name}"] == pytest.approx(np.quantile(x, p))
    assert row["pct_above_p95"] == pytest.approx((drawn > np.quantile(x, 0.95)).mean() * 100)
    assert result.scenarios.count() == 3


def test_bins_wider_than_one_position(spark):
    df = spark.range(5000).selectExpr("cast(if(id < 2000, 7, id) as double) as v")
    history = [{"position": 1, "column": "v", "valid_values": 5000, "batch": 5, "hist_p5": 0.0, "hist_p95": 4000.0}]
    got = bootstrap.simulated_batches(df, history, 20).collect()
    assert len(got) == 20 and all(r["draws"] == 5 for r in got)
    s = np.sort([7 if i < 2000 else i for i in range(5000)])
    picks = [int(hashlib.md5(f"v|{i}".encode()).hexdigest()[:15], 16) % 5000 for i in range(100)]
    means = s[picks].reshape(20, 5).mean(1)
    assert {r["sim"]: r["mean"] for r in got} == pytest.approx(dict(enumerate(means)))


def test_bootstrap_columns(spark):
    df = spark.range(600).selectExpr("id as order_id", "cast(id % 13 as double) as x", "cast(id % 5 as double) as five", "id % 31 as humidity")
    p = profile_columns(df)
    assert [r["column"] for r in bootstrap.bootstrap_columns(p).collect()] == ["x"]
    assert [r["column"] for r in bootstrap.bootstrap_columns(p, "five").orderBy("rank").collect()] == ["five", "x"]
    assert not bootstrap.bootstrap(df.limit(20), profile_columns(df.limit(20))).applied


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_positions_survive_coalesce_and_union(spark, many_ranges):
    df = spark.range(1000).withColumnRenamed("id", "k").repartition(7)
    sample = ordering.systematic_sample(df, ["k"], 10)
    expected = [(i * 100, i * 100, i) for i in range(10)]
    show = lambda d: sorted((r["k"], r["position"], r["sample_position"]) for r in d.collect())
    assert show(sample) == show(sample.coalesce(1)) == expected
    assert show(sample.unionByName(sample)) == sorted(expected * 2)
    other = spark.range(3).select(*[F.lit(-1).cast("bigint").alias(n) for n in sample.columns])
    assert show(other.unionByName(sample)) == [(-1, -1, -1)] * 3 + expected
    grouped = ordering.running_index(df.withColumn("g", F.col("k") % 3), ["k"], group=["g"], out="at").coalesce(2)
    assert all(r["at"] == r["k"] // 3 for r in grouped.collect())


def test_row_orders_with_nan_text_and_times(spark):
    import datetime

    day = datetime.datetime(2024, 3, 10, 2, 30)
    rows = [(float("nan"), "x" * 100 + "b", day), (None, "a", day), (2.0, None, day + datetime.timedelta(hours=1)), (1.0, "x" * 100 + "a", None)]
    df = spark.createDataFrame(rows, "d double, s string, t timestamp_ntz")
    found = ordering.rows_at_positions(df, ["d"], [0, 1, 2, 3])
    assert [found[i]["d"] for i in range(3)] == [None, 1.0, 2.0] and found[3]["d"] != found[3]["d"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = ordering.rows_at_positions(df, ["t", "s"], [0, 1, 2, 3])
        assert [found[i]["t"] for i in (0, 3)] == [None, day + datetime.timedelta(hours=1)]
        assert [found[i]["s"] for i in (1, 2)] == ["a", "x" * 100 + "b"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    nested = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(ValueError):
        ordering.rows_at_positions(nested, ["a"], [0])
    assert ordering.rows_at_positions(nested, [], [0])[0]["a"] == [1]


def test_nested_values_are_counted_by_value(spark):
    df = spark.sql(
        "select array(timestamp'2024-01-01 00:00:00.000001') a, struct(0.0D as x) s union all "
        "select array(timestamp'2024-01-01 00:00:00.000002'), struct(-0.0D) union all select null, null"
    )
    assert exact_distinct(df, ["a", "s"]) == {"a": 2, "s": 1}


def test_every_odd_row_is_kept(spark):
    df = spark.range(30_000).selectExpr("id", "cast(hash(id) % 1000 as double) a", "cast(hash(id, 7) % 1000 as double) b")
    found = clustering.cluster_rows(df, profile_columns(df), ["id"], ["a", "b"])
    summary = found.summary.first()
    assert summary["odd_rows"] == found.odd_rows.count() >= 1500 and isinstance(summary["converged"], bool)
    ranks = [r["rank"] for r in found.odd_rows.orderBy("distance", ascending=False).collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_sample_sorts_keys_only(spark):
    df = spark.range(500).selectExpr("id % 50 k", "repeat('long text ', 20) body", "id % 2 = 0 even", "map('a', id % 3) m")
    got = ordering.systematic_sample(df, ["k"], 20)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 20 and [r["k"] for r in got.orderBy("position").collect()] == [i * 25 // 10 for i in range(20)]
    assert "RepartitionByExpression" not in plan and "LeftSemi" in plan


def repeated_orders(spark, folder, times=5):
    """The smallest lineitem under new order keys: its amounts no longer look like identifiers, and five clusters get equal seeds."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    step = lines.agg(F.max("l_orderkey") + 1).first()[0]
    copies = spark.range(times).select(F.col("id").alias("copy"))
    copies.crossJoin(lines).withColumn("l_orderkey", F.col("l_orderkey") + F.col("copy") * step).drop("copy").write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    return con


def test_clusters_of_repeated_orders_match_the_statements(spark, tmp_path):
    con = repeated_orders(spark, tmp_path)
    for name in ("standardize_wide", "cluster_bars_wide", "odd_rows_explained_wide"):
        assert difference(name, spark, str(tmp_path), con, QUERIES, ORACLE) is None, name


def test_simulation_of_repeated_orders_matches_the_statement(spark, tmp_path):
    con = repeated_orders(spark, tmp_path)
    assert difference("bootstrap_full_wide", spark, str(tmp_path), con, QUERIES, ORACLE) is None


def test_cluster_sums_are_exact_in_any_partitioning(spark):
    rng = np.random.default_rng(9)
    x = np.clip(rng.normal(0, 3, (3000, 2)), -8, 8)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["z0", "z1"]))
    centres = [[-1.0, 0.5], [2.0, 0.0], [-1.0, 0.5]]
    label = np.array([[((p - c) ** 2).sum() for c in np.array(centres)] for p in x]).argmin(1)
    some, other = (clustering.cluster_sums(df.repartition(n), ["z0", "z1"], centres) for n in (1, 7))
    assert some == other and set(some) == {0, 1}
    for i, (n, sums) in some.items():
        assert n == (label == i).sum()
        assert [float(s) for s in sums] == pytest.approx([math.fsum(x[label == i, j]) for j in (0, 1)], abs=3000 * 2.0**-60)
    assert clustering.moved_rows(df, ["z0", "z1"], centres, centres) == 0
    assert clustering.moved_rows(df, ["z0", "z1"], centres, centres[::-1]) == sum(
        a != b for a, b in zip(label, np.array([[((p - c) ** 2).sum() for c in np.array(centres[::-1])] for p in x]).argmin(1))
    )


def test_equal_rows_are_one_point_in_the_rounds(spark, monkeypatch):
    df = spark.range(8_000).selectExpr("id", "cast(hash(id % 500) % 90 as double) a", "cast(hash(id % 500, 7) % 90 as double) b")
    profile, scanned, sums = profile_columns(df), [], clustering.cluster_sums

    def watched(rows, *rest):
        scanned.append(rows.count())
        return sums(rows, *rest)

    monkeypatch.setattr(clustering, "cluster_sums", watched)
    put_together = clustering.cluster_rows(df, profile, ["id"], ["a", "b"])
    assert max(scanned) <= 500 and "odd_rows" not in vars(put_together)
    monkeypatch.setattr(clustering, "WORTH_WEIGHING", 0.0)
    alone = clustering.cluster_rows(df, profile, ["id"], ["a", "b"])
    assert scanned[-1] == 8_000
    assert put_together.sizes == alone.sizes and put_together.centroids == alone.centroids
    for x, y in zip(put_together.summary.first(), alone.summary.first()):
        assert x == (pytest.approx(y) if isinstance(y, float) else y)
    one, other = ([tuple(r)[:3] + tuple(r)[5:] for r in f.odd_rows.orderBy("rank").collect()] for f in (put_together, alone))
    assert one == other and len(one) == put_together.summary.first()["odd_rows"] > 0
    assert put_together.squared_distances == pytest.approx(spread(alone))


def test_weighted_sums_are_exact_beyond_the_bits_of_a_double(spark):
    x = np.array([7.9, 7.9 - 2.0**-30, -0.3, 0.1])
    n = np.array([2**27 + 1, 2**26 + 3, 2**20 + 7, 5])
    df = spark.createDataFrame(pd.DataFrame({"z0": x, "n": n})).coalesce(1)
    found = clustering.cluster_sums(df, ["z0"], [[0.0], [8.0]], "n")
    for i, members in enumerate(([2, 3], [0, 1])):
        # what two numbers of 30 bits hold of each value
        exact = sum(int(n[j]) * (Fraction(float(x[j])) * 2**60 // 1) for j in members) / Fraction(2**60)
        assert found[i] == (n[members].sum(), [exact])


def test_methods_share_the_rounds_from_positions(spark, monkeypatch):
    df = spark.range(600).selectExpr("id", "cast(hash(id) % 40 as double) a", "cast(hash(id, 7) % 40 as double) b")
    runs, rounds = [], clustering._lloyd
    monkeypatch.setattr(clustering, "_lloyd", lambda *a: runs.append(1) or rounds(*a))
    found = clustering.cluster_by_methods(df, profile_columns(df), ["id"], ["positions", "ml"], ["a", "b"])
    assert len(runs) == 2 and list(found) == ["positions", "ml"]
    assert found["ml"].squared_distances <= found["positions"].squared_distances * (1 + 1e-9)


def test_statements_on_four_columns_profile_no_others(spark, tmp_path, monkeypatch):
    repeated_orders(spark, tmp_path)
    seen, profile = [], queries.profiles.profile_columns
    monkeypatch.setattr(queries.profiles, "profile_columns", lambda df, *a, **k: seen.append(df.columns) or profile(df, *a, **k))
    QUERIES["cluster_summary_wide"](spark, str(tmp_path))
    assert [sorted(c) for c in seen] == [sorted(queries.NAMED)]
