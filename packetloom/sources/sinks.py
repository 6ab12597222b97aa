"""Sinks: alert logs, JSON exports, STIX objects, audit chains, model baselines."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import scalars as S
from packetloom.functions.names import severity_label, stix_confidence
from packetloom.operators.runs import fold_rows
from packetloom.operators.ordered import OrderedGroups
from packetloom.session import durable

SECOND = 1_000_000


def write_alerts(alerts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append alerts, partitioned by category."""
    alerts.write.mode("append").partitionBy("category").format(fmt).save(path)


def write_evidence(evidence: DataFrame, path: str, clustered: bool = False) -> None:
    """Write the packets around each alert; rows cluster by alert, no file per alert. ``clustered`` says that the
    rows of an alert come together and by age already, as from ``packets_before``; they are then written as they come."""
    rows = evidence if clustered else evidence.repartition("alert_id").sortWithinPartitions("alert_id", "age")
    rows.write.mode("append").parquet(path)


# ---- audit chain ------------------------------------------------------------------------------

def audit_chain(log: DataFrame, genesis: str, segment_rows: int = 1000, hot_rows=None, parts=None) -> DataFrame:
    """Hash chain ``h = sha256(h_before || payload)`` over (log_id, ts_us, row_id, payload).

    A chain is sequential, so rows are chained in parallel inside segments, each from the genesis hash. A
    segment ends with a seal over its tail and count and the seal before it, one row per segment; the log
    ends with a row over the last seal and the totals. So a segment that is lost, moved or added shows.
    """
    groups = OrderedGroups(log, ["log_id"], ["ts_us", "row_id"], hot_rows, parts).numbered("_rn")
    rows = groups.df.withColumns({"segment": F.floor((F.col("_rn") - 1) / segment_rows),
                                  "seq": (F.col("_rn") - 1) % segment_rows + 1}).drop("_rn")
    first = hashlib.sha256(genesis.encode()).hexdigest()

    def step(head, payload):
        link = hashlib.sha256((head + payload).encode()).hexdigest()
        return link, (link,)

    links = fold_rows(rows.select("log_id", "segment", "seq", "payload"), ["log_id", "segment"], ["seq"], ["payload"],
                      lambda: first, step, "hash string")
    tails = links.groupBy("log_id", "segment").agg(F.max("seq").alias("n"), F.max_by("hash", "seq").alias("tail"))
    tails = tails.withColumn("payload", F.concat_ws("|", F.lit("SESSION_CLOSED"), "tail", F.col("n").cast("string")))

    def seal(head, tail, payload):
        link = hashlib.sha256((head + tail + payload).encode()).hexdigest()
        return link, (link,)

    seals = durable(fold_rows(tails, ["log_id"], ["segment"], ["tail", "payload"], lambda: first, seal, "hash string"))
    sealed = seals.select("log_id", "segment", (F.col("n") + 1).alias("seq"), "payload", "hash")
    ends = seals.groupBy("log_id").agg(F.max("segment").alias("last"), F.max_by("hash", "segment").alias("seal"), F.count("*").alias("segments"), F.sum("n").alias("rows"))
    total = F.concat_ws("|", F.lit("LOG_CLOSED"), F.col("segments").cast("string"), F.col("rows").cast("string"))
    closed = ends.select("log_id", (F.col("last") + 1).alias("segment"), F.lit(1).cast("bigint").alias("seq"), total.alias("payload"),
                         F.sha2(F.concat("seal", total), 256).alias("hash"))
    return links.unionByName(sealed).unionByName(closed)


# ---- STIX ---------------------------------------------------------------------------------------

def stix_objects(alerts: DataFrame, now_us, identity: str = "packetloom sensor", minutes: int | None = None) -> DataFrame:
    """STIX 2.1 objects as (kind, id, json): identity, one indicator per alert, one attack
    pattern and relationship per technique, one address object per IP.

    ``alerts`` needs mitre_ref and alert_id; the technique's relationship points from its first
    indicator.
    """
    a = alerts if minutes is None else alerts.filter(F.col("ts_us") >= now_us - minutes * 60 * SECOND)
    for c in ("explanation", "raw_evidence"):
        a = a if c in a.columns else a.withColumn(c, F.lit(None).cast("string"))
    version, now = F.lit("2.1").alias("spec_version"), S.stix_timestamp(now_us)
    me = S.stix_id("identity", F.lit(identity))
    at = S.stix_timestamp(F.col("ts_us"))
    reference = F.struct(F.lit("mitre-attack").alias("source_name"), F.col("mitre_ref").alias("description"))
    a = a.withColumns({
        "_id": S.stix_id("indicator", F.col("category"), F.col("ts_us"), F.col("source_ip"), F.substring("description", 1, 50)),
        "_ap": S.stix_id("attack-pattern", F.col("mitre_ref"))})

    def objects(df, kind, oid, *fields):
        body = F.to_json(F.struct(F.lit(kind).alias("type"), version, oid.alias("id"), *fields))
        return df.select(F.lit(kind).alias("kind"), oid.alias("id"), body.alias("json"))

    one = alerts.sparkSession.range(1, numPartitions=1)
    identities = objects(one, "identity", me, now.alias("created"), now.alias("modified"),
                         F.lit(identity).alias("name"), F.lit("system").alias("identity_class"))
    indicators = objects(
        a, "indicator", F.col("_id"), at.alias("created"), at.alias("modified"),
        F.concat_ws(": ", "category", F.substring("description", 1, 80)).alias("name"),
        F.coalesce("explanation", "description").alias("description"),
        S.stix_pattern(F.col("category"), F.col("source_ip"), F.col("dest_ip"), F.col("dest_port"), F.col("raw_evidence")).alias("pattern"),
        F.lit("stix").alias("pattern_type"), at.alias("valid_from"), F.array(F.lit("malicious-activity")).alias("indicator_types"),
        stix_confidence(F.col("severity")).alias("confidence"), me.alias("created_by_ref"),
        F.array(F.concat(F.lit("severity:"), severity_label(F.col("severity"))), F.concat(F.lit("category:"), "category")).alias("labels"),
        F.when(F.col("mitre_ref").isNotNull(), F.array(reference)).otherwise(F.array()).alias("external_references"))
    # first alert per technique: an aggregate, so a common technique is combined map-side
    firsts = a.filter(F.col("mitre_ref").isNotNull()).groupBy("mitre_ref", "_ap").agg(
        F.min_by("_id", F.struct("ts_us", "alert_id")).alias("_first"))
    technique = F.split("mitre_ref", " - ")[0]
    url = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(technique, F.lit("."), F.lit("/")), F.lit("/"))
    patterns = objects(firsts, "attack-pattern", F.col("_ap"), now.alias("created"), now.alias("modified"), F.col("mitre_ref").alias("name"),
                       F.array(F.struct(F.lit("mitre-attack").alias("source_name"), technique.alias("external_id"), url.alias("url"))).alias("external_references"))
    links = objects(firsts, "relationship", S.stix_id("relationship", F.col("_first"), F.col("_ap")), now.alias("created"), now.alias("modified"),
                    F.lit("indicates").alias("relationship_type"), F.col("_first").alias("source_ref"), F.col("_ap").alias("target_ref"))
    ips = a.select(F.explode(F.array("source_ip", "dest_ip")).alias("ip")).filter("ip is not null and ip <> ''").distinct()
    addresses = objects(ips, "ipv4-addr", S.stix_id("ipv4-addr", F.col("ip")), F.col("ip").alias("value"))
    return identities.unionByName(indicators).unionByName(patterns).unionByName(links).unionByName(addresses)


# ---- JSON export --------------------------------------------------------------------------------

def analytics_export(totals, senders, receivers, connected, protocols, flows, dns=None, tls=None, http=None) -> DataFrame:
    """One JSON document from the report tables, each of which is a top-k or one row."""
    parts = {"summary": totals, "top_senders": senders, "top_receivers": receivers, "most_connected": connected,
             "protocol_distribution": protocols, "active_flows": flows, "recent_dns": dns, "recent_tls": tls, "recent_http": http}
    rows = None
    for name, df in parts.items():
        if df is None:
            continue
        # a report is a top-k: its rows come ranked, in one partition
        part = df.select(F.lit(name).alias("part"), F.monotonically_increasing_id().alias("i"), F.to_json(F.struct("*")).alias("j"))
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda x: x["j"]).alias("items"))
    body = F.concat(F.lit('"'), "part", F.lit('":['), F.array_join("items", ","), F.lit("]"))
    return per.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(body)), ","), F.lit("}")).alias("document"))


def window_scores_sink(scored: DataFrame, path: str) -> None:
    """Window scores as CSV: start, score, label, packets, bytes."""
    scored.select("window_start_us", "score", "label", "packets", "bytes").write.mode("append").option("header", True).csv(path)


def model_baseline(features: DataFrame, names: list[str], scored: DataFrame, threshold: float) -> DataFrame:
    """One JSON row: feature means and deviations, score statistics and the threshold."""
    f = features.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    means, stds = F.struct(*[F.col(f"m_{n}").alias(n) for n in names]), F.struct(*[F.col(f"s_{n}").alias(n) for n in names])
    f = f.select(F.lit(0).alias("_all"), means.alias("means"), stds.alias("stds"))
    s = scored.agg(F.struct(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"),
                            F.max("score").alias("max")).alias("scores")).withColumn("_all", F.lit(0))
    doc = F.struct("means", "stds", "scores", F.lit(threshold).alias("threshold"))
    return f.join(F.broadcast(s), "_all").select(F.to_json(doc).alias("baseline"))
