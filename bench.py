"""Times the headline queries and prints one JSON line.

Every query is run once to warm up and then timed; a run builds the plan, executes it
in full and discards the rows. The raw panel is stored first, as the input is on a
cluster; that write is timed on its own (``store_panel``), and so are the tables that
several queries share (``store_supervised``, ``store_features``). ``duckdb`` has the
seconds of each query's SQL twin on the same files and as many threads, reading the given
tables and building everything it needs, and ``rows`` the rows of its result.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import panels
from checks.compare import connect
from checks.oracles import ORACLES
from checks.queries import QUERIES, stored_hourly_features, supervised_table
from hazeline.session import build_session

HEADLINE = (
    "overall_aqi",
    "feature_table",
    "feature_table_clock",
    "supervised_rows",
    "time_split_counts",
    "persistence_by_horizon",
    "residual_intervals",
    "walk_forward_folds",
    "city_ranking",
    "weather_correlation",
    "history_summary",
    "psi_by_feature",
    "feature_upsert",
    "refreshed_store",
    "leaderboard_history",
    "forecast_hours",
    "hazard_alerts",
    "scenario_features",
    "sequence_windows",
    "ridge_metrics",
    "walk_forward_two_inputs",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def execute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def library_query(name: str):
    """The query without the rounding that only the comparison needs."""
    return QUERIES[name].__wrapped__


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {
        "store_panel": timed(lambda: execute(panels.readings(spark, sf_dir))),
        "store_features": timed(lambda: stored_hourly_features(spark, sf_dir)),
        "store_supervised": timed(lambda: supervised_table(spark, sf_dir)),
    }
    twins, rows = {}, {}
    con = connect(sf_dir)
    con.execute(f"SET threads = {int(cpus)}")
    for name in names:
        run = library_query(name)
        execute(run(spark, sf_dir))
        seconds[name] = timed(lambda: execute(run(spark, sf_dir)))
        if name in ORACLES:
            start = time.perf_counter()
            rows[name] = len(con.execute(ORACLES[name]).fetchdf())
            twins[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "duckdb": twins, "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
