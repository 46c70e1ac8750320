"""Headline queries on one machine: one JSON line with the seconds of each."""

import json
import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")

from varve.queries import QUERIES
from varve.session import local_session

HEADLINE = [
    "latest_live", "scan_as_of", "snapshot_diff", "get_point", "multi_get", "range_scan", "ordered_scan", "seek_ge", "next_prev",
    "batch_apply", "kmerge_runs", "flush_file_meta", "level_score", "next_level_overlap", "find_file", "fold_edits",
    "compaction_retain_half", "compaction_retain_deeper", "compaction_split", "hash32", "varint_encode", "bloom_probe", "sql_join_live",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "varve-bench")
    spark.sparkContext.setLogLevel("ERROR")
    write = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    write("latest_live")  # starts the engine
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            write(name)
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
