"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["agg_sum_period", "growth_yoy", "compare_avg", "rank_entity_desc", "rank_month", "rank_min_rows", "share_count", "summary_by_quarter_qoq", "summary_by_entity_share_rank", "star_join_etl", "shared_scan_batch", "batch_verdicts", "claim_dup_spans", "span_overlap_candidates", "numeric_tokens", "claim_rejections", "verdict_outcomes", "latency_percentiles"]


def claims_of_all_kinds(n: int) -> list:
    """n claims over months, priorities, statuses and metrics: hardly two ask for the same slices."""
    from itertools import cycle, islice, product

    from claimcheck.model import Comparison, Growth, PointValue, Ranking, Share

    months = [f"{y}-{m:02d}" for y in range(1995, 2001) for m in range(1, 13)]
    subjects = [None, "urgent", "high", "final"]
    metrics = ["revenue", "orders", "avg_order_value"]
    out = []
    for k, (i, subject, metric) in enumerate(islice(cycle(product(range(1, len(months)), subjects, metrics)), n)):
        both = dict(id=str(k), span=f"{metric} {k}", confidence="high", metric=metric, period=months[i])
        earlier = months[(k // 5) % i]
        kind = (PointValue, Growth, Comparison, Share, Ranking)[(k + k // 5) % 5]
        if kind is PointValue:
            out.append(kind(**both, subject=subject, value=float(k)))
        elif kind is Growth:
            out.append(kind(**both, subject=subject, value=float(k % 90), direction="increase", baseline_period=earlier))
        elif kind is Comparison:
            out.append(kind(**both, subject=subject, value=None, direction="higher", baseline_period=earlier))
        elif kind is Share:
            name = metrics[k % 2]
            out.append(kind(**both | {"metric": name, "span": f"{name} {k}"}, subject=subject or "final", value=float(k % 90)))
        else:
            out.append(kind(**both, subject=subjects[1 + k % 2], rank=1 + k % 5, rank_from="highest", group_by="priority"))
    return out


def batch(spark: SparkSession) -> dict[str, float]:
    """Claims of all kinds verified together, in seconds."""
    from claimcheck import queries as Q
    from claimcheck.sources.dataset import attach
    from claimcheck.verify import verify_claims

    ds = attach(spark.read.parquet(f"{SF}/orders.parquet"), Q.CONFIG)
    out = {}
    for n in (60, 6000):
        claims = claims_of_all_kinds(n)
        verify_claims(ds, claims[:60], Q.CONFIG)
        t = time.perf_counter()
        verify_claims(ds, claims, Q.CONFIG)
        out[f"verify_{n}_claims"] = round(time.perf_counter() - t, 4)
    return out


def main() -> None:
    from claimcheck.queries import queries

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    for name in NAMES:  # compiled and cached once, as in a service
        found[name](spark, SF).write.format("noop").mode("overwrite").save()
    times = {}
    for name in NAMES:
        t = time.perf_counter()
        found[name](spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 4)
    times |= batch(spark)
    try:
        from claimcheck.llm import entry
    except ImportError:
        entry = None
    if entry is not None:
        for name, run in entry.queries().items():
            t = time.perf_counter()
            run(spark, SF).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
