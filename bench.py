"""Times registered queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plateview.operators.timing import run, timed_runs  # noqa: E402
from plateview.plans.catalog import QUERIES  # noqa: E402
from plateview.session import local_session  # noqa: E402
from plateview.sources.scratch import clear_stored  # noqa: E402

HEADLINE = [
    "clean_light", "clean_aggressive", "clean_classical_stemmed", "sentences", "ratings_clean", "dedup_first", "split_stratified_orders",
    "terms_phrases", "aspects_synonym", "aspects_default", "aspects_vector", "aspects_full", "evidence_sentence", "absa_flagship", "absa_orders",
    "context_compare", "gold_score", "class_report", "vocab_topk", "tfidf_weights", "nb_weights", "batch_scoring", "stream_aspects",
    "logreg_report", "sentences_learned", "terms_key_phrases", "aspects_phrases", "steps_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "plateview-bench")
    run(QUERIES["clean_light"](spark, folder))  # warm-up, not counted
    inputs = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "orders")]
    seconds, throughput = {}, {}
    for name in HEADLINE:
        took = timed_runs(spark, {name: lambda name=name: QUERIES[name](spark, folder)}, inputs).first()
        seconds[name], throughput[name] = round(took.seconds, 3), round(took.rows_per_second, 1)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        clear_stored(spark)
    rows = {t: table.count() for t, table in zip(("documents", "orders"), inputs)}
    per_second = {"absa_flagship": round(rows["documents"] / seconds["absa_flagship"], 1),
                  "absa_orders": round(rows["orders"] / seconds["absa_orders"], 1)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "reviews_per_second": per_second, "result_rows_per_second": throughput, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
