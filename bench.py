"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fieldlens import registry
from fieldlens.session import local_session

HEADLINE = (
    "schema_diff", "changes_by_type", "consecutive_diffs", "schema_matrix", "guide_diff", "cross_reference", "flatten_xml", "validate_messages",
    "batch_report", "message_diff_ordered", "migrate_messages", "similar_path_map", "page_similarity", "word_diff", "line_diff", "group_records",
    "guide_records", "change_log", "carry_forward", "expand_paths", "flatten_json", "expand_catalog", "api_endpoint_rows", "synthesize",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "fieldlens-bench")
    queries = registry.queries()
    # one small query warms the JVM and the Python workers
    queries["parse_guard"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
