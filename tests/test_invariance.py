"""Results do not depend on how the data is partitioned: every listed query
gives the same rows with 1 and with 17 shuffle partitions."""

import pytest

from runlens.plans import QUERIES

from .conftest import SF_SMALL

KEYS = ["bucket_report", "latest_progress", "best_attempt", "progress_running", "task_stats", "tool_usage",
        "match_test_cases", "expected_test_coverage", "answers_lines", "rl_sequence", "rollout_info",
        "collect_batch", "repo_leak_join", "merge_constraints", "format_hits", "token_offsets", "confirm_complete",
        "terminal_delta", "run_outcome", "render_prompt", "extract_json_commands", "scan_id_list"]


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("key", KEYS)
def test_partitioning_invariance(spark, key):
    conf = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": None}
    saved = {k: spark.conf.get(k) for k in conf}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results = []
        for n in ("1", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(_rows(QUERIES[key](spark, SF_SMALL)))
        assert results[0] == results[1]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
