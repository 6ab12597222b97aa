"""Traffic statistics and feature vectors as plain grouped aggregates.

Everything here combines map-side first. Where distinct values or entropies are asked for,
counts per value come first, so a hot group is spread over its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import scalars as S
from packetloom.functions.names import severity_label
from packetloom.functions.tls import quantum_risk, tls_grade
from packetloom.operators.ordered import OrderedGroups, nearest_rank, order_statistics, percentile_at

SECOND = 1_000_000
FLOW8 = ["total_bytes", "packet_count", "duration", "avg_inter_arrival", "bytes_per_packet",
         "packets_per_second", "bytes_per_second", "byte_ratio_out"]
FLOW14 = ["flow_duration", "fwd_packet_count", "bwd_packet_count", "fwd_bytes_total", "bwd_bytes_total",
          "fwd_pkt_len_mean", "fwd_pkt_len_std", "bwd_pkt_len_mean", "bwd_pkt_len_std", "flow_iat_mean",
          "flow_iat_std", "syn_flag_count", "ack_flag_count", "packets_per_second"]
WINDOW14 = ["packet_rate", "byte_rate", "avg_packet_size", "unique_src_ips", "unique_dst_ips",
            "unique_dst_ports", "tcp_ratio", "udp_ratio", "dns_ratio", "icmp_ratio", "syn_ratio",
            "connection_rate", "port_entropy", "ip_entropy"]
ENRICHED4 = ["tls_version_ratio", "avg_dns_label_entropy", "pq_kem_ratio", "retransmit_ratio"]
BASELINE5 = ["packet_rate", "byte_rate", "tcp_ratio", "udp_ratio", "dns_ratio"]


def window_start(ts: Column, width_us: int) -> Column:
    """Start of the aligned tumbling window."""
    return ts - F.pmod(ts, F.lit(width_us))


def n_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


# ---- totals, protocols, talkers -------------------------------------------------------------

def traffic_totals(packets: DataFrame) -> DataFrame:
    t = packets.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
                    ((F.max("ts_us") - F.min("ts_us")) / SECOND).alias("uptime"))
    up = F.col("uptime")
    return t.withColumns({"packets_per_second": _share(F.col("packets"), up),
                          "bytes_per_second": _share(F.col("bytes"), up)})


def protocol_stats(packets: DataFrame, top: int = 15) -> DataFrame:
    per = packets.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"),
        F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"))
    total = F.sum("packets").over(Window.partitionBy())  # one row per protocol
    return (per.withColumn("share_pct", F.col("packets") / total * 100)
            .orderBy(F.desc("packets"), "protocol").limit(top))


def top_by(packets: DataFrame, ip: str, top: int = 10) -> DataFrame:
    """Addresses with most bytes; exact, no candidates are evicted."""
    return (packets.groupBy(F.col(ip).alias("ip"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("packets"))
            .orderBy(F.desc("bytes"), "ip").limit(top))


def top_senders(packets: DataFrame, top: int = 10) -> DataFrame:
    return top_by(packets, "src_ip", top)


def top_receivers(packets: DataFrame, top: int = 10) -> DataFrame:
    return top_by(packets, "dst_ip", top)


def most_connected(packets: DataFrame, top: int = 10) -> DataFrame:
    pairs = packets.select("src_ip", "dst_ip").distinct()
    return (pairs.groupBy(F.col("src_ip").alias("ip")).agg(F.count("dst_ip").alias("peers"))
            .orderBy(F.desc("peers"), "ip").limit(top))


def packets_by_node(packets: DataFrame) -> DataFrame:
    return packets.groupBy("node_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


def traffic_timeline(packets: DataFrame, seconds: int = 300) -> DataFrame:
    return (packets.groupBy(F.floor(F.col("ts_us") / SECOND).alias("second"))
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
            .orderBy(F.desc("second")).limit(seconds))


# ---- flow features --------------------------------------------------------------------------

def flow_features_14(packets, window_us: int | None = 30 * SECOND, min_packets: int = 2,
                     hot_rows=None, parts=None) -> DataFrame:
    """Two-way flow features per tumbling window (None: one window for everything).

    Both directions are aggregated side by side; which one is forward is decided at the end
    by the first packet of the flow, so no row has to know it.
    """
    ends = S.conversation()
    start = window_start(F.col("ts_us"), window_us) if window_us else F.lit(0).cast("bigint")
    up = (F.col("src_ip") == ends["ip_low"]) & (F.col("src_port") == ends["port_low"])
    p = packets.select(*[c.alias(n) for n, c in ends.items()], "protocol", start.alias("window_start_us"),
                       "ts_us", "pkt_id", "size", "tcp_flags", up.alias("_up"))
    keys = [*ends, "protocol", "window_start_us"]
    gaps = OrderedGroups(p, keys, ["ts_us", "pkt_id"], hot_rows, parts).previous(_before=F.col("ts_us")).df
    iat = (F.col("ts_us") - F.col("_before")) / SECOND

    def side(name, cond):
        size = F.when(cond, F.col("size"))
        return [F.count(size).alias(f"{name}_n"), F.coalesce(F.sum(size), F.lit(0)).alias(f"{name}_b"),
                F.coalesce(F.avg(size), F.lit(0.0)).alias(f"{name}_m"),
                F.coalesce(F.stddev_pop(size), F.lit(0.0)).alias(f"{name}_s")]

    flows = gaps.groupBy(*keys).agg(
        F.greatest((F.max("ts_us") - F.min("ts_us")) / SECOND, F.lit(1e-6)).alias("flow_duration"),
        *side("u", F.col("_up")), *side("d", ~F.col("_up")),
        F.coalesce(F.avg(iat), F.lit(0.0)).alias("flow_iat_mean"),
        F.coalesce(F.stddev_pop(iat), F.lit(0.0)).alias("flow_iat_std"),
        n_where(S.has(F.col("tcp_flags"), 2)).alias("syn_flag_count"),
        n_where(S.has(F.col("tcp_flags"), 16)).alias("ack_flag_count"),
        F.min_by("_up", F.struct("ts_us", "pkt_id")).alias("_first_up"))
    first = F.col("_first_up")
    named = {"n": "packet_count", "b": "bytes_total", "m": "pkt_len_mean", "s": "pkt_len_std"}
    flows = flows.withColumns({
        **{f"fwd_{v}": F.when(first, F.col(f"u_{k}")).otherwise(F.col(f"d_{k}")) for k, v in named.items()},
        **{f"bwd_{v}": F.when(first, F.col(f"d_{k}")).otherwise(F.col(f"u_{k}")) for k, v in named.items()},
        "packets_per_second": (F.col("u_n") + F.col("d_n")) / F.col("flow_duration")})
    return flows.filter(F.col("u_n") + F.col("d_n") >= min_packets).select(*keys, *FLOW14)


def flow_features_8(packets, min_packets: int = 5, hot_rows=None, parts=None) -> DataFrame:
    """Flow features per (source, destination, destination port); both directions of a
    port-pair count as one when ``is_outbound`` is given, else every packet is outbound."""
    keys = ["src_ip", "dst_ip", "dst_port"]
    out = F.col("is_outbound") if "is_outbound" in packets.columns else F.lit(True)
    p = packets.select(*keys, "ts_us", "pkt_id", "size", "tcp_flags", "protocol", out.alias("_out"))
    gaps = OrderedGroups(p, keys, ["ts_us", "pkt_id"], hot_rows, parts).previous(_before=F.col("ts_us")).df
    iat = (F.col("ts_us") - F.col("_before")) / SECOND
    flows = gaps.groupBy(*keys).agg(
        F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("packet_count"),
        F.greatest((F.max("ts_us") - F.min("ts_us")) / SECOND, F.lit(0.001)).alias("duration"),
        F.coalesce(F.avg(F.when(iat > 0, iat)), F.lit(0.0)).alias("avg_inter_arrival"),
        F.coalesce(F.sum(F.when(F.col("_out"), F.col("size"))), F.lit(0)).alias("_bytes_out"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),  # a handful of names
        n_where(S.is_syn(F.col("tcp_flags"))).alias("syn_count"), F.max("ts_us").alias("last_seen_us"))
    total, n, dur = F.col("total_bytes"), F.col("packet_count"), F.col("duration")
    return flows.filter(n >= min_packets).withColumns({
        "bytes_per_packet": total / n, "packets_per_second": n / dur, "bytes_per_second": total / dur,
        "byte_ratio_out": F.when(total == 0, 0.5).otherwise(F.col("_bytes_out") / total)}).drop("_bytes_out")


def top_flows(flows: DataFrame, n: int = 10) -> DataFrame:
    return flows.orderBy(F.desc("total_bytes"), "src_ip", "dst_ip", "dst_port").limit(n)


def traffic_features(packets: DataFrame, keys: list[str], duration_s, enriched: bool = False) -> DataFrame:
    """Window features for groups ``keys``: rates, distinct counts, ratios and entropies.

    Packets are first counted per (group, source, destination, port). That table, not the
    packets, is then spread over the four value dimensions that need distinct counts.
    """
    proto, port = F.upper("protocol"), F.col("dst_port")
    tcp = proto.isin("TCP", "TLS", "HTTP", "SSH")
    sums = {
        "n": F.count(F.lit(1)), "bytes": F.coalesce(F.sum("size"), F.lit(0)), "tcp": n_where(tcp),
        "udp": n_where(proto == "UDP"), "dns": n_where(proto == "DNS"), "icmp": n_where(proto == "ICMP"),
        "syn": n_where(S.is_syn(F.col("tcp_flags"))),
    }
    if enriched:
        tls = F.col("tls_version")
        sums |= {
            "tls": n_where(tls.isNotNull()), "tls13": n_where(tls.contains("1.3") | (tls == "0x0304")),
            "pq": n_where(F.col("has_pq")), "retransmits": n_where(F.col("is_retransmit")),
            "dns_h": F.coalesce(F.sum("dns_label_entropy"), F.lit(0.0)), "dns_hn": F.count("dns_label_entropy"),
        }
    base = packets.groupBy(*keys, "src_ip", "dst_ip", "dst_port").agg(*[c.alias(n) for n, c in sums.items()])
    def dim(name, value):
        return F.struct(F.lit(name).alias("dim"), value.cast("string").alias("value"))

    dims = F.array(
        dim("all", F.lit(None)), dim("src", F.col("src_ip")), dim("dst", F.col("dst_ip")),
        dim("port", F.when(port > 0, port)),
        dim("conn", F.when(port > 0, F.concat_ws("|", "src_ip", port.cast("string")))))
    spread = base.select(*keys, F.explode(dims).alias("d"), *sums)
    everything = F.col("d.dim") == "all"
    spread = spread.filter(everything | F.col("d.value").isNotNull()).select(
        *keys, "d.dim", "d.value", "n", *[F.when(everything, F.col(c)).alias(c) for c in sums if c != "n"])
    counts = spread.groupBy(*keys, "dim", "value").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.col("n").cast("double")

    def entropy(dim):
        on = F.col("dim") == dim
        total = F.sum(F.when(on, n))
        return F.coalesce(F.log2(total) - F.sum(F.when(on, n * F.log2(n))) / total, F.lit(0.0))

    f = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("dim") == "all", F.col("n"))).alias("n"),
        *[F.sum(c).alias(c) for c in sums if c != "n"],
        *[n_where(F.col("dim") == d).alias(f"u_{d}") for d in ("src", "dst", "port", "conn")],
        entropy("port").alias("port_entropy"), entropy("src").alias("ip_entropy"))
    dur = F.greatest(duration_s if isinstance(duration_s, Column) else F.lit(float(duration_s)), F.lit(0.1))
    cols = {
        "packet_rate": F.col("n") / dur, "byte_rate": F.col("bytes") / dur,
        "avg_packet_size": F.col("bytes") / F.col("n"),
        "unique_src_ips": F.col("u_src").cast("double"), "unique_dst_ips": F.col("u_dst").cast("double"),
        "unique_dst_ports": F.col("u_port").cast("double"),
        **{f"{p}_ratio": F.col(p) / F.col("n") for p in ("tcp", "udp", "dns", "icmp")},
        "syn_ratio": _share(F.col("syn"), F.col("tcp")), "connection_rate": F.col("u_conn") / dur,
    }
    if enriched:
        tls = F.greatest(F.col("tls"), F.lit(1))
        cols |= {
            "tls_version_ratio": F.col("tls13") / tls, "avg_dns_label_entropy": _share(F.col("dns_h"), F.col("dns_hn")),
            "pq_kem_ratio": F.col("pq") / tls, "retransmit_ratio": _share(F.col("retransmits"), F.col("tcp")),
        }
    return f.withColumns(cols).select(
        *keys, F.col("n").alias("packets"), F.col("bytes"), *WINDOW14, *(ENRICHED4 if enriched else []))


def window_features_14(packets: DataFrame, width_us: int = 30 * SECOND) -> DataFrame:
    p = packets.withColumn("window_start_us", window_start(F.col("ts_us"), width_us))
    return traffic_features(p, ["window_start_us"], width_us / SECOND)


def flow_window_features_18(packets: DataFrame, width_us: int = 10 * SECOND) -> DataFrame:
    """Enriched features per conversation and window."""
    ends = S.conversation()
    flow = F.format_string("%s:%d<->%s:%d", ends["ip_low"], ends["port_low"], ends["ip_high"], ends["port_high"])
    p = packets.withColumns({"flow_key": flow, "window_start_us": window_start(F.col("ts_us"), width_us)})
    return traffic_features(p, ["flow_key", "window_start_us"], width_us / SECOND, enriched=True)


def group_entropy(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of ``value`` within each group."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = F.sum("c")
    return counts.groupBy(*group).agg(
        total.cast("bigint").alias("rows"),
        (F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias("entropy"))


# ---- alerts, latencies, scores --------------------------------------------------------------

def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts")).withColumn(
        "label", severity_label(F.col("severity")))


def alerts_by_category(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("category").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("severity").alias("max_severity"))


def alert_rate(alerts: DataFrame, width_us: int = 60 * SECOND) -> DataFrame:
    return alerts.groupBy(window_start(F.col("ts_us"), width_us).alias("window_start_us")).agg(
        F.count(F.lit(1)).alias("alerts"),
        n_where(F.col("severity") >= 4).alias("high_or_worse"))


def _weighted(value: str) -> dict[str, Column]:
    """Moments of the rows from their distinct values and counts."""
    v, n = F.col(value), F.col("n")
    return {"rows": F.sum("n"), "avg": F.sum(v * n) / F.sum("n"), "min": F.min(v), "max": F.max(v)}


def latency_percentiles(df: DataFrame, value: str, hot_rows=None, parts=None) -> DataFrame:
    """Average, extremes and nearest-rank percentiles (``sorted[int(n q)]``)."""
    picks = {"p50": nearest_rank(.5), "p95": nearest_rank(.95, 20), "p99": nearest_rank(.99, 100)}
    return order_statistics(df, value, picks, extra=_weighted(value), hot_rows=hot_rows, parts=parts)


LATENCY_BOUNDS = [.00001, .00005, .0001, .0005, .001, .005, .01, .05, .1]  # fixed values, seconds


def latency_histogram(df: DataFrame, value: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative bucket counts; every row is aggregated once, not once per bucket."""
    bounds = bounds or LATENCY_BOUNDS
    slots = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)],
                    F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    one = df.agg(*[n_where(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
                 F.count(value).alias("total"))
    return one.select(F.explode(slots).alias("s")).select(
        F.when(F.col("s.le") == float("inf"), "+Inf").otherwise(F.col("s.le").cast("string")).alias("le"), F.col("s.n").alias("n"))


def score_percentiles(df: DataFrame, value: str = "score", hot_rows=None, parts=None) -> DataFrame:
    """Exact P10 to P99 with linear interpolation, extremes, mean and population deviation."""
    picks = {f"p{p}": percentile_at(p / 100) for p in (10, 25, 50, 75, 90, 95, 99)}
    v, n = F.col(value), F.col("n")
    square = F.sum(v * v * n) / F.sum("n")
    extra = _weighted(value) | {"square": square}
    out = order_statistics(df, value, picks, extra=extra, hot_rows=hot_rows, parts=parts)
    spread = F.sqrt(F.greatest(F.col("square") - F.col("avg") ** 2, F.lit(0.0)))
    return out.withColumn("std", spread).drop("square")


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return per.withColumn("share_pct", F.col("rows") / F.sum("rows").over(Window.partitionBy()) * 100)


def score_separation(df: DataFrame) -> DataFrame:
    """Score statistics of attacks against the rest: gap, Cohen's d and a verdict."""
    hit, rest = F.when(F.col("y") == 1, F.col("score")), F.when(F.col("y") == 0, F.col("score"))
    s = df.agg(F.avg(hit).alias("attack_mean"), F.stddev_pop(hit).alias("attack_std"),
               F.avg(rest).alias("benign_mean"), F.stddev_pop(rest).alias("benign_std"))
    gap = F.col("attack_mean") - F.col("benign_mean")
    pooled = F.sqrt((F.col("attack_std") ** 2 + F.col("benign_std") ** 2) / 2)
    return s.withColumns({
        "gap": gap, "cohens_d": F.when(pooled > 0, gap / pooled).otherwise(0.0),
        "verdict": F.when(gap > 0.01, "OK").when(gap > 0, "WEAK").otherwise("INVERTED")})


def anomalous_vs_normal_means(df: DataFrame, features: list[str], flag: Column) -> DataFrame:
    """Per feature, the mean over anomalous and normal rows and their ratio."""
    both = df.agg(*[F.avg(F.when(flag, F.col(f))).alias(f"a_{i}") for i, f in enumerate(features)],
                  *[F.avg(F.when(~flag, F.col(f))).alias(f"n_{i}") for i, f in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a_{i}").alias("anomalous_mean"),
                              F.col(f"n_{i}").alias("normal_mean")) for i, f in enumerate(features)])
    out = both.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("ratio", F.col("anomalous_mean") / F.greatest(F.col("normal_mean"), F.lit(1e-10)))


# ---- TLS reports ----------------------------------------------------------------------------

def pq_readiness_by_host(sessions: DataFrame) -> DataFrame:
    per = sessions.groupBy("host_ip").agg(
        F.count(F.lit(1)).alias("sessions"), n_where(F.col("has_pq")).alias("pq_sessions"),
        F.max("ts_us").alias("last_seen_us"))
    return per.withColumns({"classical_sessions": F.col("sessions") - F.col("pq_sessions"),
                            "score": F.col("pq_sessions") / F.col("sessions")})


def pq_readiness_network(by_host: DataFrame) -> DataFrame:
    """The network score is the mean of the host scores, not of the sessions."""
    return by_host.agg(
        F.count(F.lit(1)).alias("tracked_hosts"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum("pq_sessions"), F.lit(0)).alias("pq_sessions"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("network_score"))


def suite_risks(sessions: DataFrame, dimension: DataFrame) -> DataFrame:
    """Distinct suites seen, with risk; the dimension is a fixed table of two dozen rows."""
    seen = sessions.groupBy("cipher_suite").agg(F.count(F.lit(1)).alias("sessions"))
    joined = seen.join(F.broadcast(dimension), F.col("cipher_suite") == F.col("suite_id"), "left")
    return joined.withColumns(quantum_risk(F.col("kex"), F.col("vulnerable")))


def vulnerability_summary(risks: DataFrame) -> DataFrame:
    """Counts over known suites; unknown ones are reported by ``suite_risks`` only."""
    known = risks.filter(F.col("suite_id").isNotNull())
    return known.agg(
        F.count(F.lit(1)).alias("total_analyzed"), n_where(F.col("vulnerable")).alias("quantum_vulnerable"),
        n_where(~F.col("vulnerable")).alias("quantum_safe"), n_where(F.col("risk") == "CRITICAL").alias("critical"))


def tls_posture_share(sessions: DataFrame) -> DataFrame:
    """Percent of sessions that are quantum-safe, only forward-secret, or weak."""
    groups = F.when(F.col("has_pq"), F.array(F.lit(0x6399))).otherwise(F.array().cast("array<int>"))
    per = sessions.groupBy("cipher_suite", "tls_version", "has_pq").agg(F.count(F.lit(1)).alias("n"))
    g = tls_grade(F.col("cipher_suite"), F.col("tls_version"), groups)
    kind = F.when(g["pq_safe"], "pq_safe").when(g["forward_secrecy"], "moderate").otherwise("weak")
    t = per.groupBy(kind.alias("posture")).agg(F.sum("n").alias("sessions"))
    return t.withColumn("share_pct", F.col("sessions") / F.sum("sessions").over(Window.partitionBy()) * 100)
