"""Headline timings; prints one JSON line.

The flow pipeline runs over the given flows and over copies of them made once,
untimed, about as many records as the published one-minute load step.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from checks import incident_checks, traffic_checks
from checks.views import policies, view
from floodplain.operators import classify, detect, evaluate, incidents, normalize, policy, rollup, snapshots
from floodplain.plans import traffic
from floodplain.session import build

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TARGET_RECORDS = int(os.environ.get("BENCH_RECORDS", "6000000"))


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def run(df) -> None:
    """Compute every row and column; keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def spread(flows, spark, copies: int):
    """The published load step's shape: all records within one minute, between some thousands of hosts.

    Every copy has its own moments and, four by four, other hosts of the same
    networks, so that no two copies fall into the same rows.
    """
    from floodplain.functions import net

    many = flows.crossJoin(F.broadcast(spark.range(copies).withColumnRenamed("id", "copy")))
    many = many.withColumn("ts", F.timestamp_millis(F.lit(traffic_checks.FROM * 1000) + (F.col("flow_id") * 7919 + F.col("copy") * 977) % 60_000))
    many = many.withColumn("flow_id", F.col("flow_id") + F.col("copy") * 1_000_000_000)
    for side in ("src", "dst"):
        many = many.withColumn(f"{side}_lo", F.col(f"{side}_lo").bitwiseXOR(F.col("copy") % 4))
        many = many.withColumn(f"{side}_addr", net.address_text(F.col("family"), F.col(f"{side}_hi"), F.col(f"{side}_lo")))
    return many.drop("copy")


def main() -> None:
    spark = build(f"local[{CPUS}]", **{
        "spark.driver.memory": "20g", "spark.sql.shuffle.partitions": str(2 * int(CPUS)), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    prefixes, rates = view(spark, SF_DIR, "prefixes"), view(spark, SF_DIR, "exporter_rates")
    once = view(spark, SF_DIR, "flows")
    base = os.path.join(work, "flows")
    once.write.parquet(base)
    base_rows = spark.read.parquet(base).count()
    copies = max(1, TARGET_RECORDS // base_rows)
    many = os.path.join(work, "many")
    spread(spark.read.parquet(base), spark, copies).repartition(2 * int(CPUS)).write.parquet(many)
    many_rows = base_rows * copies

    def classified(path):
        return classify.classify(normalize.normalize(spark.read.parquet(path), rates), prefixes)

    def snaps(path):
        return snapshots.snapshots(classified(path), 300_000)

    def evaluated(path):
        p = policies(spark, SF_DIR)
        return evaluate.evaluate(policy.select_policy(snaps(path), p), p)

    def top(path):
        host = rollup.rollup_host(classified(path), 300)
        traffic.top_talkers(host, "host", traffic_checks.FROM, traffic_checks.TO).collect()

    lengths = traffic_checks.LENGTHS
    run(classified(base))  # start the workers and the code cache
    queries = {
        "normalize_classify": timed(lambda: run(classified(base))),
        "all_rollups": timed(lambda: run(rollup.rollup_all(classified(base), 60, **lengths))),
        "top_hosts": timed(lambda: top(base)),
        "rate_windows": timed(lambda: run(rollup.rate_windows(normalize.normalize(spark.read.parquet(base), rates), [60, 300]))),
        "snapshots": timed(lambda: run(snaps(base))),
        "detection_events": timed(lambda: run(detect.detection_events(detect.detect(evaluated(base), traffic_checks.TO, stale_after_ms=1_800_000)))),
        "incident_correlation": timed(lambda: run(incidents.correlate(incident_checks.arrivals(spark, SF_DIR), asof=traffic_checks.TO))),
        "incident_list": timed(lambda: detection_list(spark)),
        "normalize_classify_load_step": timed(lambda: run(classified(many))),
        "all_rollups_load_step": timed(lambda: run(rollup.rollup_all(classified(many), 15, **lengths))),
        "detection_load_step": timed(lambda: run(detect.detect(evaluated(many), traffic_checks.TO, stale_after_ms=1_800_000))),
    }
    total = round(sum(queries.values()), 3)
    print(json.dumps({
        "metric": "headline queries", "value": total, "unit": "sec", "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "flow_records": base_rows, "load_step_records": many_rows, "cpus": int(CPUS),
        "records_per_second": {name: round(many_rows / queries[name]) for name in queries if name.endswith("load_step")},
    }), flush=True)
    spark.stop()


def detection_list(spark) -> None:
    incident_checks.iq.list_incidents(incident_checks.orders(spark, SF_DIR), "acme", limit=100).collect()


if __name__ == "__main__":
    main()
