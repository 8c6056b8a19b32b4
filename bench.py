"""Headline queries at one scale, printed as one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data
and cores.  Every query is run once untimed for class loading and code generation, then
timed to completion with a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import time

from bibliomill.plans import load_queries
from bibliomill.plans.registry import Tables
from bibliomill.session import local_session

HEADLINES = (
    "flagship_top_documents",
    "txt_04_page_hits",
    "txt_13_terms_by_targets",
    "txt_19_hits_by_word",
    "txt_04_large_vocabulary",
    "cat_01_snapshot_diff",
    "ali_05_related",
    "bib_04_families",
    "bib_07_colophon_blocks",
    "bib_22_redundant_texts",
    "bib_16_deep_records",
    "bib_26_related_works",
    "dat_01_to_07_mentions",
    "dat_08_annotated",
    "join_05_relocated_many_rules",
    "red_01_redacted",
    "src_08_excerpts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    plans = load_queries()
    tables = Tables(spark, sf_dir)
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        for timed in (False, True):
            start = time.perf_counter()
            plans[name].plan(tables).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
