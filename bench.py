"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tallyline.catalog import all_queries
from tallyline.session import builder

HEADLINE = [
    "user_score_percent",
    "summary_all_levels",
    "file_user_shares",
    "file_user_matrix",
    "attach_user_commits",
    "user_file_category_counts",
    "batch_user_percent",
    "match_batch_repositories",
    "commit_line_totals",
    "commit_branches",
    "join_commit_parent",
    "latest_commit_per_repo",
    "ingest_commits",
    "ingest_users",
    "incremental_new_commits",
    "repository_members",
    "fetch_report",
    "remap_users",
    "diff_revision_lines",
    "diff_entities",
    "score_percent_from_texts",
    "summary_json",
    "report_pages",
    "batch_documents",
    "stream_ingest_commits",
    "fetched_commits",
    "fetched_line_totals",
    "extract_entities",
    "window_score_percent",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("tallyline-bench")
        .master(f"local[{cpus}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["count_rows"](spark, sf_dir).collect()  # starts the executor threads
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
