"""Benchmark: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.  Each query is executed in full with the ``noop``
sink (every row computed, nothing collected).

Setup, reported separately as ``setup_sec`` and not in ``value``: session
start, and writing the derived input tables (history, index, refs, trees)
once as Parquet - the stored tables a deployment would read.  The graph
queries share one chain index per session, built inside the first of them
(``reachable``), so its time is in ``value``."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.plans import catalog  # noqa: E402
from strata.session import local_session  # noqa: E402
from strata.sources import fixtures  # noqa: E402

HEADLINE = [
    "branch_diff", "branch_diff_by_oid", "log_page_branch", "latest_commit", "commit_counts", "insert_new_commits",
    "upsert_commits", "reachable", "rev_list", "range_commits", "merge_status", "commit_changes", "flag_equivalent",
    "file_changes", "line_change_counts", "diff_lines", "stream_ingest",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    t_setup = time.time()
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="strata-bench")
    fixtures.materialize(spark, sf_dir)
    setup = round(time.time() - t_setup, 3)
    times = {}
    for name in names:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "setup_sec": setup}))


if __name__ == "__main__":
    main()
