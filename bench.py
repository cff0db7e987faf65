"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioframe.catalog import load_all  # noqa: E402
from folioframe.catalog.registry import QUERIES  # noqa: E402
from folioframe.session import build_session  # noqa: E402

HEADLINE = [
    "tx1_clean_markdown", "tx30_tokenize", "ch6_chunk_pages", "ch10_build_corpus", "ix1_postings", "ix2_okapi_idf",
    "rt1_bm25_search", "rt3_dense_search", "rt9_rrf_fuse", "rt20_search_hybrid", "rt31_assess_evidence",
    "ev9_aggregate_metrics", "ev12_latency_summary", "ev14_run_ablation", "wk1_upsert_by_source", "wk15_resolve_links",
    "cv4_search_sessions", "cv9_summary_selection", "ob3_model_usage", "ob11_enrich_timeline", "fb11_collect_candidates",
    "au1_transcript_range", "st7_stream_run_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", int(cpus))
    load_all()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()     # start the executor threads
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
