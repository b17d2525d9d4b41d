"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from voxloom.plans import registry
from voxloom.session import session

HEADLINE = (
    "norm_text_by_lang", "raw_post_edit_by_source", "markup_clean", "turn_wer", "corpus_wer_by_role", "turn_agreement", "gated_pseudo_labels", "stratified_split_docs",
    "stratified_rates", "ev_intervals_merge", "ev_interval_union", "ev_overlap_seconds", "ev_point_in_interval_anti", "ev_nearest_snap", "ev_chunking",
    "ev_coverage_label", "frame_der", "mapped_der", "mbr_pick", "rover_fuse", "merged_transcripts", "lexicon_topn", "vocabulary_by_lang", "plda_moments", "cosine_pairs",
    "ahc_clusters", "ngram_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["norm_text_by_lang"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers, compiles
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
