"""Headline queries at `$BENCH_SF_DIR` on `local[$BENCH_CPUS]`; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lecturelab import plans
from lecturelab.plans.registry import QUERIES
from lecturelab.session import local_session

HEADLINES = (
    "search_topk", "tfidf", "cohesion", "build_chunks", "utterances_in", "speech_around_board", "visual_prior", "regroup_utterances",
    "asr_drop_report", "ink_delta", "volatility_map", "board_cuts", "run_cost", "perf_table", "cost_by_stage", "formula_prf", "term_coverage",
    "build_segments", "hybrid_scores", "pk", "verify_citations", "validate_quiz", "latex_quality",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = os.environ.get("BENCH_QUERIES")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    plans.load_all()
    # start the executor threads and load the classes before anything is timed
    QUERIES["ends_sentence"](spark, sf).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in only.split(",") if only else HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken,
        "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
