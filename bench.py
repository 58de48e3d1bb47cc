"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from probeline.plans import load_all, registry
from probeline.session import get_session

HEADLINE = (
    "e03_mean_templates",
    "e14_all_pairs",
    "e16_genuine_pairs",
    "e17_impostor_sample",
    "m01_identification_ranks",
    "m04_roc_curve",
    "m06_equal_error_rate",
    "m08_operating_points",
    "m09_d_prime",
    "q3_subject_disjoint_identification",
    "r01_single_cross_session",
    "r02_single_shot_short_term",
    "r03_leave_last_out_short_term",
    "r04_single_shot_long_term",
    "r05_leave_last_out_long_term",
    "r18_coalesced_ranges",
    "r24_source_order",
    "g01_moving_average",
    "g06_peaks",
    "g10_beats",
    "g11_blind_windows",
    "g22_stft",
    "k02_stratified_split",
    "u04_bootstrap_interval",
    "s12_fingerprint",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    # start the JVM's tasks and one Python worker per core
    registry.QUERIES["p10_dated_records"](spark, folder).count()
    spark.range(0, 1000, 1, int(cpus)).mapInArrow(lambda batches: batches, "id long").count()
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else [q for q in registry.QUERIES if chosen == "all" or q in chosen.split(",")]
    times = {}
    for name in names:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    result = {
        "metric": "headline query time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
