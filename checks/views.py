"""Test inputs as DataFrames (Spark) and as CTEs (DuckDB)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodplain.functions import vocab
from floodplain.session import configure

from .fixture_sql import SQL

BASE = {
    "flows": "events", "timeline": "events", "incidents": "orders", "mitigations": "customer",
}

# Literal tables kept next to the views of FIXTURES.md.
SQL = {
    **SQL,
    "routes": """
SELECT * FROM (VALUES
 ('acme', 'incident.opened,incident.updated', NULL, 'noc-slack,hook'),
 ('acme', 'incident.opened', 'major', 'hook,pager'),
 ('globex', 'incident.opened,incident.closed', 'minor', 'globex-mail')
) AS t(tenant, events, min_severity, channels)
""",
    "edges": "SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in vocab.MITIGATION_EDGES)
    + ") AS t(from_state, to_state)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows in as many tasks as a shuffle has: a table may be one small file, and the work on each row much."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    if name in BASE:
        table(spark, sf_dir, BASE[name]).createOrReplaceTempView(BASE[name])
    df = spark.sql(SQL[name])
    if "ts" in df.columns:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def ctes(*names: str) -> str:
    return ",\n".join(f"{name} AS ({SQL[name]})" for name in names)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy views in the library's shape."""
    plain = view(spark, sf_dir, "policies")
    listed = view(spark, sf_dir, "thresholds").groupBy("policy_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("metric"), F.col("threshold").cast("bigint")))).alias("thresholds")
    )
    from floodplain.functions import net

    address = net.parse_address(F.col("sel_addr"))
    ms = lambda c: (F.col(c).cast("bigint") * 1000)
    return plain.join(listed, "policy_id").select(
        "policy_id", F.col("policy_id").alias("name"), F.lit(None).cast("string").alias("description"), "enabled",
        "tenant", "scope_type", "selector", address["family"].alias("sel_family"), address["hi"].alias("sel_hi"),
        address["lo"].alias("sel_lo"), F.col("sel_len").cast("int").alias("sel_len"), "sel_hostgroup",
        F.col("family").cast("int").alias("family"), "direction", ms("window_s").alias("window_ms"), "thresholds",
        "clear_percent", ms("trigger_s").alias("trigger_for_ms"), ms("clear_s").alias("clear_for_ms"),
        ms("cooldown_s").alias("cooldown_ms"), ms("hold_down_s").alias("hold_down_ms"),
        ms("update_s").alias("event_update_ms"), "severity", "mode", "priority",
        F.create_map().cast("map<string,string>").alias("labels"), "version",
    )
