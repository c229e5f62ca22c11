"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tenfold.catalog import all_queries
from tenfold.session import local_session

HEADLINE = [
    "job_01_merge",
    "job_02_recode_sample",
    "job_04_clean_sample",
    "job_06_recode_audit",
    "job_05_earnings_summary",
    "ag_07_pooled_mean_sd",
    "ag_15_pooled_correlations",
    "md_00_grouped_gram",
    "md_02_earnings_equation",
    "md_14_pooled_mixed",
    "job_10_earnings_models",
    "md_10_logistic_random_intercept",
    "md_11_logistic_random_slopes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    from tenfold.catalog import base

    # The survey tables derived from the given ones are written once and read by all others; they are timed, too.
    seconds = {}
    for name, build in (("derive_respondents", base.respondents), ("derive_clean", base.clean)):
        start = time.time()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "survey_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
