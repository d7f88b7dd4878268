"""Reading decoded flow records, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net

# One decoded record. Fields outside this list are ignored, missing ones are NULL.
RECORD_SCHEMA = (
    "flow_id BIGINT, ts TIMESTAMP, src_addr STRING, dst_addr STRING, src_port INT, dst_port INT, protocol INT, "
    "tcp_flags INT, raw_bytes BIGINT, raw_packets BIGINT, sampling_record BIGINT, sampling_options BIGINT, "
    "exporter STRING, observation_domain_id BIGINT, sequence_number BIGINT, input_interface BIGINT, "
    "output_interface BIGINT, src_asn BIGINT, dst_asn BIGINT, fragmented BOOLEAN, forwarding_status INT"
)


def _with_addresses(records: DataFrame) -> DataFrame:
    """Parse each address text once and derive the forwarding flags."""
    from ..operators.normalize import decode_forwarding_status

    df = records
    for side in ("src", "dst"):
        parsed = F.inline_outer(F.array(net.parse_address(F.col(f"{side}_addr"))))
        df = df.select("*", parsed.alias(f"{side}_family", f"{side}_hi", f"{side}_lo"))
    for side in ("src", "dst"):  # canonical text, so that one address has one spelling
        text = net.address_text(F.col(f"{side}_family"), F.col(f"{side}_hi"), F.col(f"{side}_lo"))
        df = df.withColumn(f"{side}_addr", F.when(F.col(f"{side}_lo").isNotNull(), text))
    df = df.withColumn("family", F.col("src_family")).withColumn("fragmented", F.coalesce("fragmented", F.lit(False)))
    return decode_forwarding_status(df).drop("forwarding_status")


def read_flows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _with_addresses(spark.read.schema(RECORD_SCHEMA).format(fmt).load(path))


def stream_flows(spark: SparkSession, path: str, fmt: str = "parquet", watermark: str = "2 minutes",
                 max_files: int | None = None) -> DataFrame:
    """The same records as a stream; ``ts`` is arrival time and carries the watermark."""
    reader = spark.readStream.schema(RECORD_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_addresses(reader.load(path)).withWatermark("ts", watermark)
