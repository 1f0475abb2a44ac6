"""Every registered query equals its oracle on the small tables."""

import os

import pytest

from attestry.plans.catalog import load
from compare import connect, differences
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


# One or more of every group; ``compare.py`` and ATTESTRY_ALL=1 run them all.
QUICK = """
view_passed view_failed test_outcome filter_tag_title_file hits_on_manifest line_fold core_summary mcdc_witnesses decision_result by_kind gap_lines
line_first_tests decision_detail covered_elsewhere patch_check uncovered_ranges event_phase credit_by_time in_process_owner repeated_executions probe_places
top_findings directory_health thinned_lines snapshot_diff guard_evidence candidate_lines nodes_spread name_words test_kind
declaration_diff file_changes unit_ancestors innermost_unit assertion_share tests_to_ask merge_conflicts merge_runs stale_reasons measurement_status
validate_identities lcov_lines unified_diff_lines event_columns mcdc_records needed_vectors stream_ingest
""".split()
NAMES = sorted(load()) if os.environ.get("ATTESTRY_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    problem, _ = differences(spark, con, load()[name], SMALL)
    assert problem in ("", "rows only"), problem
