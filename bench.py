"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog import views
from catalog.queries import queries
from gradeloom.session import local_session

HEADLINE = (
    "read_shards", "dense_row_index", "shard_census", "keep_valid", "build_request",
    "plan_request_chunks", "read_batch_responses", "latest_response", "merge_responses",
    "batch_gate", "conversion_summary", "top_errors", "outcome_comparison", "check_diagram",
    "classify_render_response", "mask_prompt_labels", "normalise_code", "token_prf",
    "sentence_bleu", "tfidf_cosine", "score_pairs", "metric_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"))
    views.DEALT = int(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    available = queries()
    available["split_sizes"](spark, sf_dir).collect()  # starts the session's workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "pairs_dealt_to": views.DEALT, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
