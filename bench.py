"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_ROUNDS`` how
often each query runs (the median counts).  ``baseline`` holds the same silver tables in
their plain shape, see ``workload/baseline.py``, and ``same_work`` ours written likewise;
both read ``documents`` and ``events`` from copies in as many files as there are cores,
because a single generated row group leaves all but one core idle while reading.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from signalmart.session import build_session  # noqa: E402
from signalmart.sources.shared import shared_folder, stage  # noqa: E402
from workload import baseline  # noqa: E402
from workload.inputs import Inputs  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "shape_news", "news_dedup", "sentiment_lexicon", "share_of_voice", "news_silver", "stocks_silver",
    "stocks_silver_lineitem", "trends_silver", "trend_anomaly", "gold_join", "gold_brand_health",
    "silver_roundtrip", "q1_leaderboard", "q2_alerts", "q3_category", "q4_wow", "q5_brand_type",
]

PLAIN: dict[str, Callable[[Inputs], object]] = {
    "news": baseline.news,
    "stocks": baseline.stocks,
    "stocks_lineitem": lambda i: baseline.stocks(i, i.lineitem_bars),
    "trends": baseline.trends,
}
OURS: dict[str, Callable[[Inputs], object]] = {
    "news": lambda i: stage("ours")(i.news_silver),
    "stocks": lambda i: stage("ours")(i.stocks_silver),
    "stocks_lineitem": lambda i: stage("ours")(QUERIES["stocks_silver_lineitem"](i)),
    "trends": lambda i: stage("ours")(i.trends_silver),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="signalmart-"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def typical(run: Callable[[Inputs], object], tables: str = sf_dir) -> float:
        times = []
        for _ in range(rounds):
            started = time.perf_counter()
            run(Inputs(spark, tables))
            times.append(time.perf_counter() - started)
        return round(median(times), 3)

    def in_files() -> str:
        """A copy of the tables of the comparison in many files."""
        copy = shared_folder(spark, "bench-tables")
        for table in ("documents", "events", "lineitem", "part"):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(int(cpus)).write.parquet(f"{copy}/{table}.parquet")
        return copy

    def collected(name: str) -> Callable[[Inputs], object]:
        return lambda i: QUERIES[name](i).write.format("noop").mode("overwrite").save()

    for warm in ("trends_silver", "sentiment_lexicon"):  # starts the session and compiles what all queries share
        collected(warm)(Inputs(spark, sf_dir))
    queries = {name: typical(collected(name)) for name in HEADLINE}
    copy = in_files()
    plain = {name: typical(run, copy) for name, run in PLAIN.items()}
    ours = {name: typical(run, copy) for name, run in OURS.items()}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "baseline": plain,
        "same_work": ours,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
