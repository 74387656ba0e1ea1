"""Registered queries against their oracle SQL. FIELDLENS_ALL=1 runs all of them."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, duck  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# one or two of every group; the rest runs with FIELDLENS_ALL=1 and in tools/check_queries.py
CORE = (
    "schema_diff", "changes_by_type", "diff_stats", "facet_change_rows", "class_evolution", "change_summary", "pair_counts", "guide_diff", "guide_impact",
    "cross_reference", "gap_stats", "status_stats", "resolve_sheet", "flatten_roundtrip", "validate_messages", "summarise_issues", "rebuild_xml", "validate_schema",
    "validate_catalog", "message_diff_ordered", "message_diff_unordered", "similar_path_map", "migrate_messages", "page_similarity", "line_diff", "word_diff",
    "page_plan", "concat_pages", "guide_records", "change_log", "sections", "carry_forward", "contiguous_blocks", "expand_circular", "flatten_json", "code_valid",
    "admit_batches", "folder_counts", "expand_catalog", "annotation_buckets", "api_walk_schema", "api_endpoint_rows", "synthesize", "stream_dedupe", "sql_functions",
    "message_files", "document_files", "report_files", "filter_kind", "either_or_picks", "label_values_whole",
)
NAMES = list(QUERIES) if os.environ.get("FIELDLENS_ALL") else list(CORE)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    state, _, _, note = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
    # the smallest data set has no similar paths
    assert state in ("ok", "rows-only") or (state == "EMPTY" and name == "similar_path_map"), f"{state} {note}"


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
