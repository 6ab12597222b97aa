"""Labelled flow CSV files with irregular headers and dirty values."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.scalars import attack_family, is_attack

# fixed values: accepted column names for each of the 14 flow features
COLUMNS_14 = {
    "flow_duration": ["Flow Duration"],
    "fwd_packet_count": ["Total Fwd Packets", "Fwd Packet Count", "Total Fwd Packet"],
    "bwd_packet_count": ["Total Backward Packets", "Total Bwd packets", "Bwd Packet Count"],
    "fwd_bytes_total": ["Total Length of Fwd Packets", "Total Length of Fwd Packet", "Fwd Packets Total Length", "TotalLenofFwdPkts"],
    "bwd_bytes_total": ["Total Length of Bwd Packets", "Total Length of Bwd Packet", "Bwd Packets Total Length", "TotalLenofBwdPkts"],
    "fwd_pkt_len_mean": ["Fwd Packet Length Mean", "Fwd Pkt Len Mean"],
    "fwd_pkt_len_std": ["Fwd Packet Length Std", "Fwd Pkt Len Std"],
    "bwd_pkt_len_mean": ["Bwd Packet Length Mean", "Bwd Pkt Len Mean"],
    "bwd_pkt_len_std": ["Bwd Packet Length Std", "Bwd Pkt Len Std"],
    "flow_iat_mean": ["Flow IAT Mean"],
    "flow_iat_std": ["Flow IAT Std"],
    "syn_flag_count": ["SYN Flag Count", "SYN Flag Cnt"],
    "ack_flag_count": ["ACK Flag Count", "ACK Flag Cnt"],
    "packets_per_second": ["Flow Packets/s", "Flow Pkts/s"],
}


def _finite(text: Column) -> Column:
    """Text as a double; what is missing, not a number or not finite becomes 0."""
    v = F.trim(text).try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(v)


def _header(spark: SparkSession, path: str) -> list[str]:
    """Trimmed column names of the first line; repeated names get a number."""
    line = spark.read.text(path).first()[0].lstrip("﻿")
    names, seen = [], {}
    for raw in next(csv.reader([line], skipinitialspace=True), []):
        name = raw.strip()
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return names


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature columns as doubles, ``label`` and ``y``. Rows with too few or too many fields are
    dropped. ``path`` is one file, or files with the same header."""
    names = _header(spark, path)
    label = next((n for n in names if n.lower() == "label"), None)
    if label is None:
        raise ValueError(f"no label column in {path}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_ragged", T.StringType())])
    rows = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
            .option("columnPruning", False)  # only whole rows show that they are ragged
            .option("columnNameOfCorruptRecord", "_ragged").csv(path))
    rows = rows.filter(F.col("_ragged").isNull())
    text = F.trim(F.col(f"`{label}`"))
    return rows.select(*[_finite(F.col(f"`{n}`")).alias(n) for n in names if n != label],
                       attack_family(text).alias("label"), is_attack(text).alias("y"))


def read_flow_dir(spark: SparkSession, paths: list[str], keep_benign: float = 1.0, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Union of several CSV files. A sampling operator: ``keep_benign`` keeps that fraction of
    the benign rows and ``max_rows`` a random subset, both by a hash of the row whatever the partitions;
    both leave every row in by default."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_flow_csv(spark, p) for p in paths])
    names = [c for c in df.columns if c not in ("label", "y")]
    df = df.fillna(0.0, names)
    if keep_benign < 1.0:
        share = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
        df = df.filter((F.col("y") != 0) | (share < keep_benign))
    if max_rows is not None:
        df = df.orderBy(F.xxhash64(*df.columns, F.lit(seed + 1)), *df.columns).limit(max_rows)
    return df


def _first_existing(df: DataFrame, candidates: list[str]) -> Column:
    by_name = {c.strip().lower(): c for c in df.columns}
    found = next((c for c in candidates if c in df.columns), None)
    found = found or next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)
    return F.col(f"`{found}`") if found else F.lit(0.0)


def map_columns_14(df: DataFrame) -> DataFrame:
    """The 14 flow features by the first column name that exists, 0 without one."""
    rest = [c for c in ("label", "y") if c in df.columns]
    return df.select(*[_first_existing(df, names).cast("double").alias(out) for out, names in COLUMNS_14.items()], *rest)


def map_columns_proxy14(df: DataFrame) -> DataFrame:
    """Stand-ins in the window feature space for detectors trained on windows."""
    def col(*names):
        return _first_existing(df, list(names)).cast("double")

    port, proto = col("Destination Port"), col("Protocol")
    forward = F.greatest(col("Total Fwd Packets"), F.lit(1.0))
    # the average counts unless it is zero in the whole table
    filled = df.agg((F.coalesce(F.sum(col("Average Packet Size")), F.lit(0.0)) != 0).alias("_filled")).withColumn("_all", F.lit(0))
    df = df.withColumn("_all", F.lit(0)).join(F.broadcast(filled), "_all").drop("_all")
    size = F.when(F.col("_filled"), col("Average Packet Size")).otherwise(col("Packet Length Mean"))
    columns = {
        "packet_rate": col("Flow Packets/s"), "byte_rate": col("Flow Bytes/s"), "avg_packet_size": size,
        "unique_src_ips": F.lit(1.0), "unique_dst_ips": F.lit(1.0), "unique_dst_ports": F.log1p(port),
        "tcp_ratio": (proto == 6).cast("double"), "udp_ratio": (proto == 17).cast("double"),
        "dns_ratio": (port == 53).cast("double"), "icmp_ratio": (proto == 1).cast("double"),
        "syn_ratio": F.greatest(F.lit(0.0), F.least(F.lit(1.0), col("SYN Flag Count") / forward)),
        "connection_rate": col("Fwd Packets/s"), "port_entropy": F.log1p(F.abs(col("Packet Length Std"))),
        "ip_entropy": F.log1p(F.abs(col("Flow Duration")) / 1e6),
    }
    rest = [c for c in ("label", "y") if c in df.columns]

    def clean(c):
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)

    return df.select(*[clean(c).alias(n) for n, c in columns.items()], *rest)
