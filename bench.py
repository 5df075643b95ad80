"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from ebbtide.plans import catalogue
from ebbtide.session import build

HEADLINE = {
    "decline_mix": "decline reasons with 30-day recovery",
    "churn_diagnostic": "the whole diagnostic in one row",
    "unrecovered_worklist": "open failures to chase",
    "departures_worklist": "who left and why",
    "schema_violations": "every contract rule on six tables",
    "standard_feature_panel": "15 features at six as-of moments",
    "single_feature_auc": "leakage screen, exact AUC",
    "person_period": "expansion to months at risk",
    "life_table": "competing-risk life table",
    "competing_risk_curves": "survival and incidence per unit",
    "concordance_index": "Harrell's C",
    "brier_scores": "reweighted Brier at four horizons",
    "customer_value": "lifetime value and shortfall per unit",
    "qini_curve": "three models at 21 budgets",
    "profit_curve": "profit of every campaign size",
    "offer_recommendation": "best offer under a budget",
    "retry_policy_comparison": "six retry policies in money",
    "holdout_assignment": "sha-256 arms",
    "incrementality": "lift with its interval",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalogue()

    def once(name: str) -> float:
        start = time.time()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    once("decline_mix")  # start the JVM's compilers before anything is timed
    times = {name: once(name) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
