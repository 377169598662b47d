"""Wall seconds of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then REPEAT times; the median counts. Results are written to
Spark's noop sink, so every row is computed in full.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))
HEADLINE = """sr_tokenize sr_bm25 sr_fuzzy_rank sr_hash_vector sr_cosine sr_rrf sr_hybrid gr_impact gr_flow gr_neighborhood gr_deadcode gr_coupling
gr_coupling_pairs gr_branch_diff st_union_overlay st_overlay_edges ing_incremental_plan res_call_tiers xmod_link src_parse_java jn_5way ag_counter""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tessera.plans.catalog import QUERIES
    from tessera.session import local_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in [n for n in HEADLINE if n in QUERIES]:
        took = []
        for run in range(REPEAT + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
