"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tripledger.plans import load_all
from tripledger.plans.registry import QUERIES

HEADLINE = [
    "fx1_weekly_rates",
    "cad2_apply_weekly_fx",
    "grp1_transaction_groups",
    "ded1_dedup_exact",
    "ded2_flag_possible_duplicates",
    "rnk1_best_match",
    "trip_cad_cost",
    "lin7_receipt_totals",
    "alc1_prorate_money",
    "clm6_expense_result",
    "clm7_journal",
    "txt6_find_total",
    "txt15_alcohol_detect",
    "nrm3_normalize_bnc",
    "rev2_fuzzy_line_match",
    "man1_manifest_receipts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tripledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
