"""Benchmark: run every registered report at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is timed from building its plan to the end of a full execution
(written to Spark's no-op sink, so every row is produced and nothing is
collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from tradelens.plans.catalog import queries
    from tradelens.session import build_session

    spark = build_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", cpus * 2)), app="tradelens-bench")
    qs = queries()
    # warm the JVM once and open the tables once (every query shares the lazy table frames)
    from tradelens.plans.catalog import tables_for
    spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet")).select("l_orderkey").write.format(
        "noop").mode("overwrite").save()
    tables_for(spark, sf_dir)
    timings: dict[str, float] = {}
    failed: dict[str, str] = {}
    for key, fn in qs.items():
        if only and key not in only:
            continue
        t0 = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[key] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep timing the others
            failed[key] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": sf, "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
