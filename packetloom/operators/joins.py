"""Range, interval and as-of joins as equi joins, running aggregates or size-checked broadcasts.

Spark turns a bare range condition into a nested loop. Address ranges therefore join on the
/16 prefix, intervals on time buckets, and "latest before" questions become a union with a
running aggregate, which never pairs the rows of a hot key with each other.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import service_name
from packetloom.functions.scalars import ip_number, is_private_ip, joint_confidence
from packetloom.operators.ordered import OrderedGroups, Running
from packetloom.session import literal_table

BROADCAST_ROWS = 200_000
_SLOT = 65536


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast behind a size check; beyond it the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if small_enough(df, limit) else df


def cidr_ranges(spark, cidrs: list[str]) -> DataFrame:
    """IPv4 networks as number ranges, both ends inclusive."""
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    rows = [(str(n), int(n.network_address), int(n.broadcast_address)) for n in nets if n.version == 4]
    return literal_table(spark, rows, "cidr string, lo bigint, hi bigint")


def _slotted(ranges: DataFrame) -> DataFrame:
    slots = F.sequence(F.floor(F.col("lo") / _SLOT), F.floor(F.col("hi") / _SLOT))
    return ranges.withColumn("_slot", F.explode(slots))


def in_ranges(df: DataFrame, ip: Column, ranges: DataFrame, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi (``how='left_semi'``) or anti join of addresses with number ranges."""
    keyed = df.withColumn("_ip", ip_number(ip)).withColumn("_at", F.floor(F.col("_ip") / _SLOT))
    dim = broadcast_if_small(_slotted(ranges.select("lo", "hi")), limit)
    hit = (F.col("_at") == F.col("_slot")) & F.col("_ip").between(F.col("lo"), F.col("hi"))
    return keyed.join(dim, hit, how).drop("_ip", "_at")


def geo_enriched(df: DataFrame, ip: str, ranges: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``country`` and ``city`` by address range; private addresses are named as such.

    ``ranges`` (lo, hi, country, city) must not overlap. Only distinct public addresses meet
    the ranges when those are too many to broadcast.
    """
    dim = _slotted(ranges.select("lo", "hi", "country", "city"))
    hit = (F.col("_at") == F.col("_slot")) & F.col("_ip").between(F.col("lo"), F.col("hi"))

    def looked_up(rows, table):
        keyed = rows.withColumn("_ip", F.when(~is_private_ip(F.col(ip)), ip_number(F.col(ip))))
        return keyed.withColumn("_at", F.floor(F.col("_ip") / _SLOT)).join(table, hit, "left").drop(
            "_ip", "_at", "_slot", "lo", "hi")

    if small_enough(dim, limit):
        out = looked_up(df, F.broadcast(dim))
    else:
        public = df.filter(~is_private_ip(F.col(ip))).select(ip).distinct()
        out = df.join(looked_up(public, dim), ip, "left")
    private = is_private_ip(F.col(ip))
    return out.withColumns({"country": F.when(private, "Private").otherwise(F.coalesce("country", F.lit("Unknown"))),
                            "city": F.when(private, "LAN").otherwise(F.coalesce("city", F.lit("Unknown")))})


def label_by_interval(df, ts: str, intervals, row_id: str, bucket: int = 60_000_000,
                      default: str = "BENIGN", limit: int = 10_000) -> DataFrame:
    """Label of the first interval (by start, then end) that holds ``ts``, both ends inclusive."""
    iv = intervals.select("start_us", "end_us", "label").withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("start_us") / bucket), F.floor(F.col("end_us") / bucket))))
    rows = df.withColumn("_at", F.floor(F.col(ts) / bucket))
    if small_enough(iv, limit):  # one row per bucket, so no row of df is repeated
        spans = F.array_sort(F.collect_list(F.struct("start_us", "end_us", "label")))
        per = iv.groupBy("_bucket").agg(spans.alias("_spans"))
        inside = F.filter("_spans", lambda s: F.col(ts).between(s["start_us"], s["end_us"]))
        out = rows.join(F.broadcast(per), F.col("_at") == F.col("_bucket"), "left")
        found = F.try_element_at(inside, F.lit(1))["label"]
        return out.withColumn("label", F.coalesce(found, F.lit(default))).drop("_at", "_bucket", "_spans")
    hit = (F.col("_at") == F.col("_bucket")) & F.col(ts).between(F.col("start_us"), F.col("end_us"))
    firsts = rows.select(row_id, ts, "_at").join(iv, hit).groupBy(row_id).agg(
        F.min(F.struct("start_us", "end_us", "label"))["label"].alias("label"))
    return df.join(firsts, row_id, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def overlaps_any(windows, start: str, end: str, row_id: str, intervals, hot_rows=None, parts=None) -> DataFrame:
    """``y = 1`` when [start, end] meets an interval: among the intervals that begin by ``end``
    the furthest end must reach ``start``. One pass, no pairs."""
    spans = intervals.select(F.col("start_us").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_seq"),
                             F.col("end_us").alias("_reach"))
    rows = windows.select(F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.col(row_id).cast("bigint").alias("_seq"), "*")
    both = spans.unionByName(rows, allowMissingColumns=True)
    run = OrderedGroups(both, [], ["_at", "_kind", "_seq"], hot_rows, parts).running(
        _far=Running("max", F.col("_reach"))).df
    hit = F.coalesce(F.col("_far") >= F.col(start), F.lit(False))
    return run.filter("_kind = 1").select(*windows.columns, hit.cast("int").alias("y"))


RULE_EXTRAS, ML_EXTRAS = ("evidence", "mitre_ref"), ("importances",)


def correlated_alerts(rules, ml, window_us: int = 30_000_000, hot_rows=None, parts=None) -> DataFrame:
    """Whenever an alert arrives, pair it with the latest alert of the other kind on the same
    flow, at most ``window_us`` older. ``rules``: flow_key, ts_us, seq, category, confidence;
    ``ml``: flow_key, ts_us, seq, anomaly_score, detector_type. Evidence and technique of a rule's alert (``evidence``,
    ``mitre_ref``) and the deviations behind a score (``importances``, a map) come along where the tables have them."""
    run = alert_arrivals(rules, ml, hot_rows, parts)
    return matched(run.df.filter(within(window_us)))


def alert_arrivals(rules, ml, hot_rows=None, parts=None) -> OrderedGroups:
    r = rules.select("flow_key", "ts_us", F.lit(0).alias("kind"), "seq",
                     F.struct("ts_us", "category", "confidence", *[c for c in RULE_EXTRAS if c in rules.columns]).alias("_rule"))
    m = ml.select("flow_key", "ts_us", F.lit(1).alias("kind"), "seq",
                  F.struct("ts_us", "anomaly_score", "detector_type", *[c for c in ML_EXTRAS if c in ml.columns]).alias("_ml"))
    both = r.unionByName(m, allowMissingColumns=True)
    return OrderedGroups(both, ["flow_key"], ["ts_us", "kind", "seq"], hot_rows, parts).running(
        rule=Running("last", F.col("_rule")), ml=Running("last", F.col("_ml")))


def within(window_us: int) -> Column:
    return F.abs(F.col("rule.ts_us") - F.col("ml.ts_us")) <= window_us


def matched(arrivals: DataFrame) -> DataFrame:
    return arrivals.select(
        "flow_key", "ts_us", "kind", "seq", F.col("rule.ts_us").alias("rule_ts_us"), "rule.category",
        F.col("rule.confidence").alias("rule_confidence"), F.col("ml.ts_us").alias("ml_ts_us"),
        F.col("ml.anomaly_score").alias("ml_score"), "ml.detector_type",
        joint_confidence(F.col("rule.confidence"), F.col("ml.anomaly_score")).alias("joint_confidence"),
        *[f"{side}.{c}" for side, extras in (("rule", RULE_EXTRAS), ("ml", ML_EXTRAS)) for c in extras
          if c in arrivals.schema[side].dataType.names])


def cross_layer(matches: DataFrame, top: int = 3) -> DataFrame:
    """Why both layers agree: ``top_evidence`` (the rule's first factors), ``top_features`` (the largest deviations, by size
    and name) and a readable ``cross_layer`` text. ``matches``: correlated alerts with evidence, technique and importances."""
    size = lambda e: F.abs(e["value"])

    def larger_first(a, b):
        return (F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))

    ranked = F.array_sort(F.filter(F.map_entries("importances"), lambda e: e["value"].isNotNull()), larger_first)
    out = matches.withColumns({
        "top_evidence": F.slice(F.coalesce("evidence", F.expr("array()").cast(matches.schema["evidence"].dataType)), 1, top),
        "top_features": F.coalesce(F.slice(ranked, 1, top), F.expr("array()").cast("array<struct<key:string,value:double>>"))})
    proof = F.transform("top_evidence", lambda e: F.concat(e["metric"], F.lit(" "), F.coalesce(e["observed"], F.lit("?")),
                                                           F.coalesce(F.concat(F.lit(" ("), e["threshold"], F.lit(")")), F.lit(""))))
    drift = F.transform("top_features", lambda e: F.format_string("%s %+.1f sd", e["key"], e["value"]))
    text = F.concat_ws(
        "\n", F.format_string("%s: two layers agree, joint confidence %.1f%%", "flow_key", 100 * F.col("joint_confidence")),
        F.format_string("rule %s at %.1f%%, %s", "category", 100 * F.col("rule_confidence"), F.coalesce("mitre_ref", F.lit("no technique"))),
        F.when(F.size(proof) > 0, F.concat(F.lit("  seen: "), F.array_join(proof, "; "))),
        F.format_string("model %s with score %.3f", "detector_type", "ml_score"),
        F.when(F.size(drift) > 0, F.concat(F.lit("  off: "), F.array_join(drift, ", "))))
    return out.withColumn("cross_layer", text)


def packets_before(packets, alerts, n: int = 200, min_severity: int = 4, hot_rows=None, parts=None) -> DataFrame:
    """For each alert of at least ``min_severity``, the last ``n`` packets up to its time.

    Packets are numbered over the whole capture; an alert learns the number of the last packet
    before it from the same running count. Packets go in blocks of ``n`` numbers, each with the block before it, so an alert
    meets one block that holds all it needs. Only packets and alerts are shuffled, never the pairs, and the rows
    of an alert come out together, by age.
    """
    p = packets.select(F.col("ts_us").alias("_at"), F.lit(0).alias("_kind"), F.col("pkt_id").alias("_seq"),
                       F.lit(1).alias("_one"))
    a = alerts.filter(F.col("severity") >= min_severity).select(
        F.col("ts_us").alias("_at"), F.lit(1).alias("_kind"), F.col("alert_id").alias("_seq"), F.lit(0).alias("_one"))
    run = OrderedGroups(p.unionByName(a), [], ["_at", "_kind", "_seq"], hot_rows, parts).running(
        rn=Running("sum", F.col("_one").cast("bigint"))).df
    own, tasks = F.floor((F.col("rn") - 1) / n), int(run.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes become many rows
    blocks = run.filter("_kind = 0").select(
        F.explode(F.array(own, own + 1)).alias("_block"), F.struct("rn", F.col("_seq").alias("pkt_id"), F.col("_at").alias("ts_us")).alias("_packet"))
    blocks = blocks.repartition(tasks, "_block").groupBy("_block").agg(F.array_sort(F.collect_list("_packet")).alias("_packets"))  # at most 2 n of them
    wanted = run.filter("_kind = 1 and rn > 0").select(F.col("_seq").alias("alert_id"), F.col("rn").alias("_last"), own.alias("_block")).repartition(tasks, "_block")
    first = F.element_at("_packets", 1)["rn"]
    start = F.greatest(F.col("_last") - (n - 1), first)
    latest = F.reverse(F.slice("_packets", (start - first + 1).cast("int"), (F.col("_last") - start + 1).cast("int")))
    return wanted.join(blocks, "_block").select("alert_id", "_last", F.inline(latest)).select(
        "alert_id", "pkt_id", "ts_us", (F.col("_last") - F.col("rn") + 1).alias("age"))


# fixed values: technique references of the rule categories
MITRE = {
    "PORT_SCAN": "T1046 - Network Service Discovery",
    "SYN_FLOOD": "T1498.001 - DoS: Direct Flood",
    "DNS_TUNNEL": "T1071.004 - App Layer Protocol: DNS",
    "DNS_EXFIL": "T1048.003 - Exfiltration Over Alternative Protocol: DNS",
    "DNS_FLOOD": "T1071.004 - App Layer Protocol: DNS",
    "ARP_SPOOF": "T1557.002 - ARP Cache Poisoning",
    "BRUTE_FORCE": "T1110 - Brute Force",
    "TTL_ANOMALY": "T1090.003 - Proxy: Multi-hop Proxy",
    "PROTO_ANOMALY": "T1036 - Masquerading",
    "ICMP_TUNNEL": "T1095 - Non-Application Layer Protocol",
    "ICMP_FLOOD": "T1095 - Non-Application Layer Protocol",
}
def category_dimension(spark) -> DataFrame:
    return literal_table(spark, list(MITRE.items()), "category string, mitre_ref string")


def response_actions(alerts: DataFrame) -> Column:
    """What to do about an alert, worked out from its own severity, ends and technique."""
    have = set(alerts.columns)
    severity = F.col("severity") if "severity" in have else F.lit(3)
    source = F.col("source_ip") if "source_ip" in have else F.lit(None).cast("string")
    dest = F.col("dest_ip") if "dest_ip" in have else F.lit(None).cast("string")
    port = F.concat(F.lit(":"), F.col("dest_port").cast("string")) if "dest_port" in have else F.lit("")
    return F.array_compact(F.array(
        F.concat(F.when(severity >= 4, "contain ").otherwise("watch "), source),
        F.when(severity >= 3, F.concat(F.lit("examine "), dest, F.coalesce(port, F.lit("")))),
        F.when(severity >= 5, F.lit("page the officer on duty")),
        F.concat(F.lit("compare with "), F.split("mitre_ref", " - ")[0])))


def with_category_dims(alerts: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Add technique, response actions and, where there is a port, its service name.

    ``actions`` (category, response_actions) is the caller's own playbook, a row for each category at most.
    """
    out = alerts.join(F.broadcast(category_dimension(alerts.sparkSession)), "category", "left")  # eleven fixed rows
    own = response_actions(out)
    if actions is not None:
        playbook = actions.select("category", F.col("response_actions").alias("_planned"))
        out = out.join(playbook, "category", "left").withColumn("response_actions", F.coalesce("_planned", own)).drop("_planned")
    else:
        out = out.withColumn("response_actions", own)
    if "dest_port" in alerts.columns:
        out = out.withColumn("service", service_name(F.col("dest_port")))
    return out
