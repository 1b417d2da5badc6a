import csv
import glob

import pytest
from pyspark.sql import functions as F

import colscope
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES
from colscope.plans import sinks
from colscope.sources import files, texts

SMALL = "/root/testdata/sf0.001"


def test_text_sizes(spark):
    samples = [("", 0, 0), ("a", 1, 1), ("a\nb", 2, 3), ("a\nb\n", 2, 4), ("añ😀", 1, 3)]
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(samples)], "id int, t string")
    got = [(r["lines"], r["chars"]) for r in texts.text_stats(df, "t", ["id"]).orderBy("id").collect()]
    assert got == [(s[1], s[2]) for s in samples]


def test_write_texts(spark, tmp_path):
    df = spark.createDataFrame([("in/a.b.pdf", "one\ntwo"), ("c", "x")], "src string, body string")
    texts.write_texts(df, "body", str(tmp_path / "out"), source="src", per_document=True)
    got = {r["document"]: r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert got == {"a.b.txt": "one\ntwo\n", "c.txt": "x\n"}
    same = spark.createDataFrame([("y/a.pdf", "two"), ("x/a.pdf", "one"), ("z/a.pdf", None), ("b", "three")], "src string, body string")
    texts.write_texts(same, "body", str(tmp_path / "rows"), source="src")
    got = {r["document"]: r["text"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert got == {"a.txt": "one", "a (2).txt": "two", "a (3).txt": None, "b.txt": "three"}


def test_csv_keeps_blanks(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("  lead", "trail  "), ("a,b", 'q"')], "x string, y string"), str(tmp_path / "t.csv"))
    (part,) = glob.glob(f"{tmp_path}/t.csv/part-*")
    assert list(csv.reader(open(part, newline=""))) == [["x", "y"], ["  lead", "trail  "], ["a,b", 'q"']]


def test_merge_parts(spark):
    rows = [("g", "2.pdf", "bb"), ("g", "1.pdf", "a"), ("g", "Todo.PDF", "zz"), ("h", "todo.pdf", "q"), ("h", "x", None)]
    df = spark.createDataFrame(rows, "grp string, name string, body string")
    got = {r["grp"]: (r["parts"], r["merged"]) for r in texts.merge_parts(df, "grp", ["name"], "body", "name", "todo.pdf").collect()}
    assert got == {"g": (2, "a\nbb"), "h": (1, "")}
    only = spark.createDataFrame([("k", "todo.pdf", "old"), (None, "1", "n")], "grp string, name string, body string")
    assert {tuple(r) for r in texts.merge_parts(only, "grp", ["name"], "body", "name", "todo.pdf").collect()} == {("k", 0, 0, ""), (None, 0, 1, "n")}
    sizes = texts.merge_size_report(only, "grp", "body", "name", "todo.pdf").collect()
    assert {(r.grp, r.is_total, r.parts, r.merged_bytes) for r in sizes} == {("k", False, 0, 0), (None, False, 1, 1), (None, True, 1, 1)}
    small = texts.merge_parts(df, "grp", ["name"], "body", chunk_bytes=3).where("grp = 'g'").orderBy("chunk").collect()
    assert "\n".join(r["merged"] for r in small) == "a\nbb\nzz" and len(small) > 1


def test_file_inventory(spark, tmp_path):
    for name in ("one/a.pdf", "one/B.PDF", "one/x.txt", "one/deep/c.pdf", "two/y.txt", "three/deep/z.pdf", "root.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    assert [tuple(r) for r in files.file_inventory(spark, str(tmp_path), "pdf").collect()] == [("one", 2)]
    assert tuple(files.file_inventory_totals(spark, str(tmp_path), "pdf").first()) == (2, 3)
    flat = files.file_inventory(spark, str(tmp_path / "two"), ".TXT").collect()
    assert [tuple(r) for r in flat] == [(".", 1)]


def test_output_folder():
    assert sinks.output_folder("/data/x.parquet") == "/data/profile_x"
    assert sinks.output_folder("x.parquet", "/out/") == "/out/profile_x"
    assert sinks.output_folder("x.parquet") == "./profile_x"


def test_whole_analysis(spark, tmp_path):
    df = spark.range(400).selectExpr(
        "id", "cast((id * 37) % 101 as double) as `a,\"<b>`", "cast((id * 37) % 101 * 2 + id % 3 as double) as twice",
        "cast(id % 29 as double) as c", "if(id % 2 = 0, null, 'k') as gaps",
    )
    found = colscope.analyze(df, ["id"], simulations=30, batch=20)
    assert found.clusters.applied and found.simulation.applied
    kpis = {r["metric"]: r["value"] for r in colscope.summary_kpis(found).collect()}
    assert kpis["rows"] == 400 and kpis["columns"] == 5 and kpis["strong_pairs"] == found.pairs.count() >= 1
    assert kpis["useful_columns"] + kpis["review_columns"] + kpis["dropped_columns"] == 5
    folder = str(tmp_path / "profile_t")
    colscope.write_results(found, folder)
    tables = {}
    for name in colscope.csv_tables(found):
        (part,) = glob.glob(f"{folder}/{name}.csv/part-*")
        tables[name] = list(csv.reader(open(part, encoding="utf-8", newline="")))
    assert len(tables) == 12 and len(tables["profile"]) == 6 and len(tables["profile"][0]) == 24
    assert tables["profile"][2][0] == 'a,"<b>'
    assert len(tables["bootstrap_summary"][0]) == 18
    (page,) = glob.glob(f"{folder}/report.html/part-*")
    html = open(page, encoding="utf-8").read()
    assert "a,&quot;&lt;b&gt;" in html and html.index("<h2>Needs attention") < html.index("<h2>Next steps")
    assert html.rstrip().endswith("</html>")


def test_analysis_without_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    found = colscope.analyze(df)
    assert not found.clusters.applied and not found.simulation.applied and found.pairs.count() == 0
    assert [r["topic"] for r in found.digest.orderBy("rank").collect()][:2] == ["useful_columns", "clustering_not_applied"]
    colscope.write_results(found, str(tmp_path / "out"))


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize(
    "name",
    ["profile_nulls_sparse", "pearson_matrix_sparse", "column_groups_docs", "feature_selection_wide",
     "insights_pairs_wide", "kmeans_rounds_wide", "merge_size_conversations"],
)
def test_against_duckdb(spark, duck, name):
    assert difference(name, spark, SMALL, duck, QUERIES, ORACLE) is None


def test_scan_is_pruned(spark):
    df = colscope.read_table(spark, f"{SMALL}/lineitem.parquet").select("l_tax").where(F.col("l_tax") > 0.02)
    plan = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan and "GreaterThan(l_tax,0.02)" in plan


def test_the_profile_file_needs_no_other_result(spark, tmp_path, monkeypatch):
    from checks import queries

    df = spark.range(200).selectExpr("id as l_orderkey", "cast(id % 7 as int) as l_linenumber", "id * 0.25D as price", "if(id % 3 = 0, null, 'x') as flag")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = colscope.analyze(spark.read.parquet(f"{tmp_path}/lineitem.parquet"), ["l_orderkey"], simulations=20, batch=20)
    whole = colscope.csv_tables(found)["profile"].collect()

    def refuse(*_, **__):
        raise AssertionError("the whole analysis was run")

    monkeypatch.setattr(queries.analyses, "analyze", refuse)
    assert queries.QUERIES["csv_profile_lineitem"](spark, str(tmp_path)).collect() == whole


def test_overview_does_not_rank_the_odd_rows(spark):
    df = spark.range(400).selectExpr("id", "cast((id * 37) % 101 as double) a", "cast(id % 29 as double) b")
    found = colscope.analyze(df, ["id"], simulations=5, batch=20)
    kpis = {r["metric"]: r["value"] for r in colscope.summary_kpis(found).collect()}
    assert "odd_rows" not in vars(found.clusters)
    assert kpis["odd_rows"] == found.clusters.odd_rows.count() > 0
