"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Each query runs BENCH_RUNS times (default 2, the first one cold) into a sink that keeps nothing; the last run counts.
"""

import json
import os
import time

from checks.catalog import QUERIES
from sentilake.session import build_session

HEADLINE = (
    "daily_trend_rolling7 brand_positive_trend change_alert_by_keyword kpi_row score_histogram source_breakdown "
    "top_comments comment_cards brand_summary clean_beauty clean_price clean_restaurant forum_posts page_links "
    "page_blocks item_links tweet_author_lookup drop_known_comments ingest_new_comments ingest_rerun review_apply "
    "review_progress batch_scoring class_report confusion stratified_split_documents stream_ingest train_and_score"
).split()


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        for run in range(runs if name != "train_and_score" else 1):
            start = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            warm[name] = round(time.perf_counter() - start, 3)
            cold.setdefault(name, warm[name])
    print(
        json.dumps(
            {
                "metric": "headline queries, total of the last run of each",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "first_run": cold,
                "sf": os.path.basename(d.rstrip("/")),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
