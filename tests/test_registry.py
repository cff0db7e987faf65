"""The driver contract, and a sample of registered queries against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as entry  # noqa: E402
import check_oracles as check  # noqa: E402

SAMPLE = ["tx5_normalize_heading_levels", "ch5_split_children", "ix9_sync_plan", "rt1_bm25_search", "rt18_pack_token_budget",
          "ev12_latency_summary", "wk6_list_revisions", "wk15_resolve_links", "cv9_summary_selection", "ob7_context_usage",
          "fb14_research_runs", "rt30_filter_for_summary", "au1_transcript_range", "src6_render_page", "st5_stream_dedupe"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, name):
    problem, _ = check.compare(entry.queries()[name](spark, sf_dir), check.connect(sf_dir), entry.oracle_sql()[name])
    assert problem is None
