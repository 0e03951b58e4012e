"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with warm seconds of each."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from setwise.plans import catalogue

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("wide_and", "wide_or", "wide_xor", "wide_and_words", "packed_or_card", "pairwise_consecutive", "pair_measures", "rank_all", "select_j", "runs", "range_between_context", "bsi_sum", "bsi_sum_slices", "bsi_topk", "bsi_transpose_count", "chunk_stats", "portable_round_trip")


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    got = {}
    for name in QUERIES:
        times = []
        for _ in range(3):
            began = time.time()
            catalogue.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        got[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "total warm seconds of headline queries", "value": round(sum(got.values()), 3), "unit": "sec", "queries": got, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
