"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from colscope.session import local_session  # noqa: E402

HEADLINES = [
    "schema_summary_events",
    "profile_basic_lineitem",
    "percentiles_lineitem",
    "profile_order_wide",
    "pearson_pairs_sparse",
    "strong_pairs_wide",
    "column_groups_wide",
    "feature_selection_wide",
    "insights_columns_sparse",
    "sample_orders",
    "odd_rows_explained_wide",
    "bootstrap_full_wide",
    "text_stats_documents",
    "merge_parts_conversations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, folder).collect()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(folder).name}
        )
    )


if __name__ == "__main__":
    main()
