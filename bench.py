"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from attestry.plans.catalog import load
from attestry.plans.model import INGESTED, Model
from attestry.session import local_session

HEADLINE = [
    "ranked_files", "core_summary", "line_fold", "mcdc_witnesses", "by_kind", "test_outcome", "view_passed", "run_diff", "patch_check", "line_detail",
    "event_phase", "credit_by_time", "in_process_owner", "affected_tests", "snapshot_diff", "candidate_lines", "assertion_share", "lcov_export",
    "merge_runs", "tests_to_ask", "open_obligation_export",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.range(1).count()

    def ingest() -> None:
        model = Model(spark, sf_dir)
        for name in sorted(INGESTED):
            model.table(name)
        model.evidence

    seconds = {"ingest": timed(ingest)}
    for name in HEADLINE:
        query = load()[name]
        seconds[name] = timed(lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline queries, ingest included", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
