"""The HTML report as a DataFrame of lines in page order.

The page asks four questions: what needs attention, what each column is good for, what hangs
together, and what the simulated ranges say. Long lists end with the number of entries left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fixed_decimals, html_text, whole_number
from ..session import local_rows
from .analyze import Analysis

# Entries shown of each list. A display limit only: the results themselves are whole.
SHOWN = {"findings": 60, "columns": 150, "pairs": 80, "groups": 40, "odd_rows": 40, "ranges": 40, "risks": 40, "charts": 80, "models": 40}

STYLE = """
:root { color-scheme: light dark; }
body { font: 15px/1.5 system-ui, sans-serif; max-width: 72rem; margin: 2rem auto; padding: 0 1rem; }
dl { display: flex; flex-wrap: wrap; gap: 1.5rem; } dt { opacity: .7; } dd { margin: 0; font-size: 1.4rem; }
li.high::marker { content: "!! "; } li.medium::marker { content: "!  "; } li.low::marker { content: "   "; }
table { border-collapse: collapse; } td, th { padding: .2rem .8rem .2rem 0; text-align: left; vertical-align: top; }
tr + tr { border-top: 1px solid #8884; } .more { font-style: italic; }
"""


def shown(name: str, digits: int | None = None) -> Column:
    c = F.col(name)
    return html_text(F.coalesce(c.cast("string"), F.lit(""))) if digits is None else fixed_decimals(c, digits)


def joined(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


class Page:
    def __init__(self, spark):
        self.spark, self.blocks = spark, []

    def add(self, lines: DataFrame) -> None:
        self.blocks.append(lines.select(F.lit(len(self.blocks)).alias("section"), F.col("rank").cast("bigint").alias("rank"), "line"))

    def say(self, *lines: str) -> None:
        self.add(local_rows(self.spark, list(enumerate(lines)), "rank int, line string"))

    def entries(self, source: DataFrame, rank: str, line: Column, most: int, tag: str, head: list[str] | None = None) -> None:
        """A list or table of the first entries, and how many there are besides."""
        heads = "<tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" if head else ""
        self.say(f"<{tag}>{heads}")
        self.add(source.where(F.col(rank) <= most).select(F.col(rank).alias("rank"), line.alias("line")))
        self.say(f"</{tag}>")
        rest = source.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0")
        self.add(rest.select(F.lit(0).alias("rank"), F.format_string("<p class='more'>and %d more</p>", "n").alias("line")))

    def cells(self, source: DataFrame, rank: str, columns: dict[str, Column], most: int) -> None:
        line = joined("<tr>", *(joined("<td>", c, "</td>") for c in columns.values()), "</tr>")
        self.entries(source, rank, line, most, "table", list(columns))


def report_lines(result: Analysis) -> DataFrame:
    """(section, rank, line): every line of the page with its place."""
    page = Page(result.profile.sparkSession)
    page.say("<!doctype html>", "<html lang='en'>", "<meta charset='utf-8'>", "<title>What the table holds</title>", f"<style>{STYLE}</style>", "<h1>What the table holds</h1>", "<dl>")
    page.say(f"<div><dt>rows</dt><dd>{result.rows}</dd></div>", f"<div><dt>columns</dt><dd>{result.columns}</dd></div>")
    for title, frame in (
        ("kept columns", result.selection.where("decision = 'use'")),
        ("correlated pairs", result.pairs),
        ("blocks", result.groups),
        ("odd rows", result.clusters.odd_rows),
        ("simulated columns", result.simulation.summary),
    ):
        page.add(frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("rank"), F.format_string(f"<div><dt>{title}</dt><dd>%d</dd></div>", "n").alias("line")))
    page.say("</dl>", "<h2>Needs attention</h2>")
    finding = joined("<li class='", shown("severity"), "'><b>", shown("subject"), "</b> ", shown("message"), " <small>", shown("category"), "</small></li>")
    page.entries(result.insights, "rank", finding, SHOWN["findings"], "ul")
    _columns(page, result)
    _relations(page, result)
    if result.simulation.applied:
        _ranges(page, result)
    page.say("<h2>Next steps</h2>")
    chart = joined("<li>", shown("chart"), " of ", shown("column_x"), F.when(F.col("column_y") != "", joined(" against ", shown("column_y"))).otherwise(""), ": ", shown("reason"), "</li>")
    page.entries(result.advice, "rank", chart, SHOWN["charts"], "ol")
    model = joined("<li>", shown("column"), " ", shown("score", 3), " (", shown("type"), ", ", shown("advice"), "): ", shown("detail"), "</li>")
    page.entries(result.ml, "rank", model, SHOWN["models"], "ol")
    page.say("</html>")
    return reduce(DataFrame.unionByName, page.blocks)


def _columns(page: Page, result: Analysis) -> None:
    page.say("<h2>Columns</h2>")
    page.add(result.selection_summary.select(F.lit(0).alias("rank"), joined("<p>", shown("conclusion"), " A score of ", shown("threshold", 2), " keeps a column", F.when(F.col("applied"), "; later steps use kept and doubtful columns only.").otherwise("; later steps use all."), "</p>").alias("line")))
    gap = joined("<meter max='100' value='", shown("null_pct", 2), "'></meter> ", shown("null_pct", 2))
    page.cells(
        result.selection, "position",
        {
            "column": joined("<b>", shown("column"), "</b> ", shown("analytic_type")),
            "verdict": joined(shown("decision"), " ", shown("score", 3)),
            "blank, %": gap,
            "distinct, %": shown("distinct_pct", 3),
            "strongest partner": joined(shown("correlated_with"), " ", shown("max_correlation", 3)),
            "because": shown("reasons"),
            "so": shown("actions"),
        },
        SHOWN["columns"],
    )


def _relations(page: Page, result: Analysis) -> None:
    page.say("<h2>What hangs together</h2>")
    pair = joined("<li>", shown("column_1"), " and ", shown("column_2"), ": r ", shown("r", 6), ", ", shown("strength"), "</li>")
    page.entries(result.pairs, "rank", pair, SHOWN["pairs"], "ol")
    block = joined("<li>", html_text(F.array_join("columns", ", ")), ": mean |r| ", shown("mean_abs_r", 4), "</li>")
    page.entries(result.groups, "group", block, SHOWN["groups"], "ul")
    if not result.clusters.applied:
        return
    page.add(result.clusters.summary.select(F.lit(0).alias("rank"), joined("<p>", shown("conclusion"), " Measured on ", html_text(F.array_join("features", ", ")), ".</p>").alias("line")))
    segment = joined("<li>segment ", whole_number(F.col("cluster")), ": ", whole_number(F.col("size")), " rows (", shown("pct", 2), "%), mean distance ", shown("mean_distance", 4), ", ", shown("reading"), "</li>")
    page.entries(result.clusters.clusters, "rank", segment, 1000, "ul")
    odd = result.clusters.odd_rows
    fixed = ("rank", "cluster", "distance", "z_score", "severity", "reason", "explanation")
    keys = [n for n in odd.columns if n not in fixed]
    row = html_text(F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]))) if keys else F.lit("")
    far = joined("<li class='", shown("severity"), "'>", row, " segment ", whole_number(F.col("cluster")), ", ", shown("reason"), ": ", shown("explanation"), "</li>")
    page.entries(odd, "rank", far, SHOWN["odd_rows"], "ul")


def _ranges(page: Page, result: Analysis) -> None:
    page.say("<h2>Simulated ranges</h2>")
    page.add(result.simulation.conclusion.select(F.lit(0).alias("rank"), joined("<p>", shown("conclusion"), " ", whole_number(F.col("simulations")), " batches of ", whole_number(F.col("batch")), " values.</p>").alias("line")))
    span = lambda name, digits: joined(shown(f"{name}_p5", digits), " .. <b>", shown(f"{name}_p50", digits), "</b> .. ", shown(f"{name}_p95", digits))
    page.cells(
        result.simulation.summary, "position",
        {"column": shown("column"), "mean so far": shown("hist_mean", 4), "mean of a batch": span("sim_mean", 4), "total of a batch": span("sim_total", 2), "reading": shown("reading")},
        SHOWN["ranges"],
    )
    risk = joined("<li class='", shown("severity"), "'>", shown("column"), ": ", shown("indicator"), " ", shown("value", 4), ", ", shown("reading"), "</li>")
    page.entries(result.simulation.risks, "rank", risk, SHOWN["risks"], "ul")


def html_report(result: Analysis) -> DataFrame:
    """The page, one line per row, in order."""
    return report_lines(result).orderBy("section", "rank").select(F.col("line").alias("value"))
