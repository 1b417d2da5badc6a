"""Explains a table: profile, selection, correlation, clusters, scenarios and findings on Spark."""

from .operators.profile import profile_columns
from .plans.analyze import Analysis, analyze, summary_kpis
from .plans.report import html_report
from .plans.sinks import csv_tables, output_folder, write_results
from .session import local_session, materialize
from .sources.tables import read_table, schema_summary

__all__ = [
    "Analysis", "analyze", "csv_tables", "html_report", "local_session", "materialize",
    "output_folder", "profile_columns", "read_table", "schema_summary", "summary_kpis", "write_results",
]
