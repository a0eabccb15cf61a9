"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``build_corpus`` cleans, sections, chunks and vectorises all documents and
writes the result; the searches after it read what it wrote.
"""

from __future__ import annotations

import json
import os
import sys
import time

from galley.plans import assets, catalogue
from galley.session import session

HEADLINE = (
    "topk_vector", "topk_keyword", "retrieve", "term_vectors", "article_nodes", "page_nodes", "tokenize",
    "intent", "profile_bundle", "audit_all", "evaluate", "report_counts", "extract_questions", "audit_trace",
    "latest_stage", "tool_pairing", "gap_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = sys.argv[1:] or HEADLINE
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    fns, times = catalogue.queries(), {}

    t0 = time.time()
    assets.chunks(spark, sf_dir)
    times["build_corpus"] = round(time.time() - t0, 3)
    for name in picked:
        t0 = time.time()
        fns[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
