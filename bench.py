"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from vigilspark.plans import registry
from vigilspark.session import local_session

HEADLINE = ["d1_d2_rule_hits", "f_levels", "f1_f6_f11_f12_scores", "f13_categories", "e14_e15_link_verdicts", "b3_b4_fold_documents", "h1_h3_tfidf", "j2_j5_three_levels", "f7_f9_h5_ml_layer"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    registry.queries()["i4_source_counts"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        began = time.time()
        registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    extra = {"messages": n, "messages_per_second": round(n / times["f1_f6_f11_f12_scores"])}
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
