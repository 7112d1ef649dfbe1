"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sharelens.plans import catalogue
from sharelens.session import session

#: The analyses of the published run log that did work, and the matching and consolidation operators.
HEADLINE = [
    "metric_summary", "basic_metrics_grouping_sets", "complete_vs_fractional_window", "alternative_denominators", "coverage_threshold_sensitivity", "historical_scenarios", "area_reclassification_pivot",
    "shift_share_summary", "collaboration_profile", "partner_countries", "maturity_scenarios", "rank_bounds", "overlap_inflation", "missingness_by_cell", "bootstrap_ci", "corpus_expansion_summary",
    "leadership_by_window", "impact_by_country_window", "country_rank_area_window", "evidence_consolidated", "dedupe_best_confidence", "title_fuzzy_match", "venue_tiers", "surrogate_keys",
]


def main() -> None:
    path, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["basic_metrics_window"](spark, path).write.format("noop").mode("overwrite").save()  # starts the JVM's code
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
