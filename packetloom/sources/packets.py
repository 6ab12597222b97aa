"""Packet tables and streams: summaries from files, sensor messages, flows replayed as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKETS = T.StructType([
    T.StructField("pkt_id", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("node_id", T.StringType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("tcp_flags", T.IntegerType()), T.StructField("ttl", T.IntegerType()),
])
# a sensor sends single packets or batches of them
MESSAGE = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("packet", PACKETS),
                        T.StructField("packets", T.ArrayType(PACKETS))])


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = PACKETS) -> DataFrame:
    """Packet summaries from Parquet, ORC, JSON lines or CSV; the schema is never inferred."""
    return spark.read.format(fmt).schema(schema).option("header", True).load(path)


def from_messages(messages: DataFrame) -> DataFrame:
    """One row per packet of single and batch messages, tagged with the sending node."""
    every = F.concat(F.coalesce(F.col("packets"), F.array().cast(MESSAGE["packets"].dataType)),
                     F.when(F.col("packet").isNotNull(), F.array("packet")).otherwise(F.array().cast(MESSAGE["packets"].dataType)))
    rows = messages.select(F.col("node_id").alias("_node"), F.explode(every).alias("p")).select("_node", "p.*")
    return rows.withColumn("node_id", F.coalesce("_node", "node_id")).drop("_node")


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded packets of many sensors from files landing in ``path``."""
    reader = spark.readStream.format(fmt).schema(PACKETS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def message_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Unbounded packets from JSON messages on a Kafka topic (needs the Kafka connector)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return from_messages(raw.select(F.from_json(F.col("value").cast("string"), MESSAGE).alias("m")).select("m.*"))


# fixed values: flag bits by name
_FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128, "NS": 256}


def flags_from_names(names):
    """Bit mask of ``SYN|ACK`` style text; empty text means a SYN."""
    listed = F.split(F.upper(names), r"\|")
    mask = F.lit(0)
    for name, bit in _FLAGS.items():
        mask = mask + F.when(F.array_contains(listed, name), bit).otherwise(0)
    return F.when(F.length(F.trim(F.coalesce(names, F.lit("")))) == 0, 2).otherwise(mask)


def flows_as_packets(flows: DataFrame, src_ip="Src IP", dst_ip="Dst IP", src_port="Src Port", dst_port="Dst Port",
                     label="Label", row_id="row_id", ts="ts_us") -> DataFrame:
    """Labelled connections as one SYN packet each, for running the rules on them."""
    def column(name, default):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default)) if name in flows.columns else F.lit(default)

    def port(name):
        return F.coalesce(F.trim(column(name, "0")).try_cast("double").cast("int"), F.lit(0))

    text = F.trim(column(label, "BENIGN"))
    return flows.select(
        F.col(row_id).alias("pkt_id"), F.col(ts).alias("ts_us"), F.lit(None).cast("string").alias("node_id"),
        F.trim(column(src_ip, "0.0.0.0")).alias("src_ip"), F.trim(column(dst_ip, "0.0.0.0")).alias("dst_ip"),
        port(src_port).alias("src_port"), port(dst_port).alias("dst_port"), F.lit("TCP").alias("protocol"),
        F.lit(60).cast("bigint").alias("size"), F.lit(2).alias("tcp_flags"), F.lit(64).alias("ttl"), text.alias("label"),
        F.when(F.upper(text) == "BENIGN", 0).otherwise(1).alias("y"))
