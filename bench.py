"""Times the headline queries and prints one JSON line.

Every query runs to the end, all columns, without keeping its result. `snapshots` and
`snapshots_crowded` are the one-off cost of deriving, cleaning and storing both rosters,
the usual ones and those with crowded keys; the other queries read them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rosterloom.queries import CROWDED, QUERIES, snapshots  # noqa: E402
from rosterloom.session import local_session  # noqa: E402

HEADLINE = (
    "clean_rosters", "batch_semi_join", "one_sided_ids", "key_cascade", "linked_pairs",
    "unmatched_registry", "unmatched_upload", "duplicate_keys", "duplicate_key_rows", "head_counts",
    "eligibility_wide", "id_lengths", "school_code_mismatch", "parent_name_mismatch",
    "address_similarity", "address_mismatch", "case_number_mismatch", "district_summary",
    "district_summary_crowded", "enrollment_check",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    times = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # starts the executor threads
    timed("snapshots", lambda: snapshots(spark, sf_dir))
    timed("snapshots_crowded", lambda: snapshots(spark, sf_dir, CROWDED))
    for name in sys.argv[1:] or HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(json.dumps({
        "metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
