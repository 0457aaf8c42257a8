"""Headline queries at one scale; prints a single JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.registry import all_queries  # noqa: E402
from panelwright.session import local_session  # noqa: E402

HEADLINE = [
    "panel_features", "panel_features_with_gaps", "panel_targets", "panel_issues", "longitudinal_job",
    "verify_split", "stratified_partition", "canonical_snapshots", "match_strong", "title_candidates",
    "identity_map", "pair_cohort", "parsed_cells", "parsed_words", "score_portfolio", "discrimination",
    "marginal_perturbation", "route_interventions", "token_similarity", "table_fingerprint",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=os.environ.get("BENCH_CPUS", "8"),
                          app="bench")
    registered = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    times = {}
    for name in wanted:
        start = time.time()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
