"""Queries over packets, TLS sessions and scores: statistics and feature vectors."""

from pyspark.sql import functions as F

from packetloom.functions.tls import risk_dimension
from packetloom.operators import aggregates as A
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.sources import bindings as B

_TOT = "sum(size)::bigint"


@query("agg_traffic_totals", with_("packets", f"""select count(*) as packets, {_TOT} as bytes, (max(ts_us) - min(ts_us)) / 1e6 as uptime,
 count(*) / uptime as packets_per_second, bytes / uptime as bytes_per_second from packets""", "uptime packets_per_second bytes_per_second"))
def totals(spark, d):
    return A.traffic_totals(B.packets(spark, d))


@query("agg_protocol_stats", with_("packets", f"""select protocol, count(*) as packets, {_TOT} as bytes, min(ts_us) as first_seen_us, max(ts_us) as last_seen_us,
 100.0e0 * count(*) / sum(count(*)) over () as share_pct from packets group by 1 order by packets desc, protocol limit 15""", "share_pct"))
def protocols(spark, d):
    return A.protocol_stats(B.packets(spark, d))


for _name, _ip, _fn in (("senders", "src_ip", A.top_senders), ("receivers", "dst_ip", A.top_receivers)):
    query(f"agg_top_{_name}", with_("packets", f"""select {_ip} as ip, {_TOT} as bytes, count(*) as packets
 from packets group by 1 order by bytes desc, ip limit 10"""))(lambda s, d, f=_fn: f(B.packets(s, d)))


@query("agg_most_connected", with_("packets", """select src_ip as ip, count(distinct dst_ip) as peers from packets group by 1 order by peers desc, ip limit 10"""))
def most_connected(spark, d):
    return A.most_connected(B.packets(spark, d))


@query("agg_packets_by_node", with_("packets", f"select node_id, count(*) as packets, {_TOT} as bytes from packets group by 1"))
def by_node(spark, d):
    return A.packets_by_node(B.packets(spark, d))


@query("agg_traffic_timeline", with_("packets", f"""select ts_us // 1000000 as second, count(*) as packets, {_TOT} as bytes from packets group by 1 order by 1 desc limit 300"""))
def timeline(spark, d):
    return A.traffic_timeline(B.packets(spark, d))


_FLOW14_SQL = """f0 as (select *, case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip else dst_ip end as ip_low,
  case when (src_ip, src_port) <= (dst_ip, dst_port) then src_port else dst_port end as port_low,
  case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_ip else src_ip end as ip_high,
  case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_port else src_port end as port_high,
  {start} as window_start_us from conv),
 f1 as (select *, first_value(src_ip) over w as init_ip, first_value(src_port) over w as init_port, (ts_us - lag(ts_us) over w) / 1e6 as iat
  from f0 window w as (partition by ip_low, port_low, ip_high, port_high, protocol, window_start_us order by ts_us, pkt_id)),
 f2 as (select *, src_ip = init_ip and src_port = init_port as fwd from f1)
 select_final ip_low, port_low, ip_high, port_high, protocol, window_start_us, greatest((max(ts_us) - min(ts_us)) / 1e6, 1e-6) as flow_duration,
  count(*) filter (fwd) as fwd_packet_count, count(*) filter (not fwd) as bwd_packet_count,
  coalesce(sum(size) filter (fwd), 0)::bigint as fwd_bytes_total, coalesce(sum(size) filter (not fwd), 0)::bigint as bwd_bytes_total,
  coalesce(avg(size) filter (fwd), 0) as fwd_pkt_len_mean, coalesce(stddev_pop(size) filter (fwd), 0) as fwd_pkt_len_std,
  coalesce(avg(size) filter (not fwd), 0) as bwd_pkt_len_mean, coalesce(stddev_pop(size) filter (not fwd), 0) as bwd_pkt_len_std,
  coalesce(avg(iat), 0) as flow_iat_mean, coalesce(stddev_pop(iat), 0) as flow_iat_std,
  count(*) filter (tcp_flags & 2 > 0) as syn_flag_count, count(*) filter (tcp_flags & 16 > 0) as ack_flag_count,
  count(*) / flow_duration as packets_per_second from f2 group by all having count(*) >= {least}"""
_FLOW14_D = "flow_duration fwd_pkt_len_mean fwd_pkt_len_std bwd_pkt_len_mean bwd_pkt_len_std flow_iat_mean flow_iat_std packets_per_second"


@query("agg_flow_features_14", with_("conv", _FLOW14_SQL.format(start="ts_us - ts_us % 30000000", least=2), _FLOW14_D))
def flow14(spark, d):
    return A.flow_features_14(B.conversations_packets(spark, d))


@query("agg_flow_features_14_whole", with_("conv", _FLOW14_SQL.format(start="cast(0 as bigint)", least=5), _FLOW14_D))
def flow14_whole(spark, d):
    return A.flow_features_14(B.conversations_packets(spark, d), window_us=None, min_packets=5)


_FLOW8_SQL = """g0 as (select *, (ts_us - lag(ts_us) over (partition by src_ip, dst_ip, dst_port order by ts_us, pkt_id)) / 1e6 as iat from {src})
 select_final src_ip, dst_ip, dst_port, sum(size)::bigint as total_bytes, count(*) as packet_count,
 greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001e0) as duration, coalesce(avg(iat) filter (iat > 0), 0) as avg_inter_arrival,
 list_sort(list(distinct protocol)) as protocols, count(*) filter (tcp_flags & 2 > 0 and tcp_flags & 16 = 0) as syn_count, max(ts_us) as last_seen_us,
 total_bytes / packet_count as bytes_per_packet, packet_count / duration as packets_per_second, total_bytes / duration as bytes_per_second,
 case when total_bytes = 0 then 0.5 else 1.0e0 end as byte_ratio_out from g0 group by 1, 2, 3 having count(*) >= {least}"""
_FLOW8_D = "duration avg_inter_arrival bytes_per_packet packets_per_second bytes_per_second byte_ratio_out"


@query("agg_flow_features_8", with_("conv", _FLOW8_SQL.format(src="conv", least=5), _FLOW8_D))
def flow8(spark, d):
    return A.flow_features_8(B.conversations_packets(spark, d))


@query("agg_top_flows", with_("packets", "t as (" + with_("packets", _FLOW8_SQL.format(src="packets", least=2), _FLOW8_D)
       + ") select_final * from t order by total_bytes desc, src_ip, dst_ip, dst_port limit 10"))
def top_flows(spark, d):
    return A.top_flows(A.flow_features_8(B.packets(spark, d), min_packets=2))


def _feature_sql(source, keys, dur, enriched=False):
    ent = "(select {k}, -sum(c * 1.0e0 / t * log2(c * 1.0e0 / t)) as h from (select {k}, {v}, count(*) as c, sum(count(*)) over (partition by {k}) as t from x where {w} group by {k}, {v}) group by {k})"
    tcp = "upper(protocol) in ('TCP','TLS','HTTP','SSH')"
    extra = f""", count(*) filter (tls_version in ('TLS 1.3')) / greatest(count(tls_version), 1) as tls_version_ratio, coalesce(avg(dns_label_entropy), 0) as avg_dns_label_entropy,
  count(*) filter (has_pq) / greatest(count(tls_version), 1) as pq_kem_ratio, case when count(*) filter ({tcp}) > 0 then count(*) filter (is_retransmit) / count(*) filter ({tcp}) else 0 end as retransmit_ratio""" if enriched else ""
    return f"""{source},
 a as (select {keys}, count(*) as packets, sum(size)::bigint as bytes, count(*) / {dur} as packet_rate, sum(size) / {dur} as byte_rate, avg(size) as avg_packet_size,
  count(distinct src_ip)::double as unique_src_ips, count(distinct dst_ip)::double as unique_dst_ips, count(distinct dst_port) filter (dst_port > 0)::double as unique_dst_ports,
  count(*) filter ({tcp}) / count(*) as tcp_ratio, count(*) filter (upper(protocol) = 'UDP') / count(*) as udp_ratio,
  count(*) filter (upper(protocol) = 'DNS') / count(*) as dns_ratio, count(*) filter (upper(protocol) = 'ICMP') / count(*) as icmp_ratio,
  case when count(*) filter ({tcp}) > 0 then count(*) filter (tcp_flags & 2 > 0 and tcp_flags & 16 = 0) / count(*) filter ({tcp}) else 0 end as syn_ratio,
  count(distinct concat(src_ip, '|', dst_port)) filter (dst_port > 0) / {dur} as connection_rate {extra} from x group by {keys})
 select_final a.*, coalesce(p.h, 0) as port_entropy, coalesce(i.h, 0) as ip_entropy from a left join {ent.format(k=keys, v='dst_port', w='dst_port > 0')} p using ({keys})
  left join {ent.format(k=keys, v='src_ip', w='true')} i using ({keys})"""


_WIN_D = "packet_rate byte_rate avg_packet_size tcp_ratio udp_ratio dns_ratio icmp_ratio syn_ratio connection_rate port_entropy ip_entropy"


@query("agg_window_features_14", with_("packets", _feature_sql(
    "x as (select *, ts_us - ts_us % 30000000 as window_start_us from packets)", "window_start_us", "30.0e0"), _WIN_D))
def window14(spark, d):
    return A.window_features_14(B.packets(spark, d))


def enriched_packets(spark, d):
    eid = F.col("pkt_id")
    return B.conversations_packets(spark, d).withColumns({
        "tls_version": F.when(eid % 5 == 0, "TLS 1.3").when(eid % 5 == 1, "TLS 1.2"),
        "has_pq": eid % 10 == 0, "is_retransmit": eid % 7 == 0,
        "dns_label_entropy": F.when(eid % 4 == 0, F.col("size") / 500)})


@query("agg_flow_window_features_18", with_("conv", _feature_sql(
    """x as (select *, concat(case when (src_ip, src_port) <= (dst_ip, dst_port) then concat(src_ip, ':', src_port, '<->', dst_ip, ':', dst_port)
  else concat(dst_ip, ':', dst_port, '<->', src_ip, ':', src_port) end) as flow_key, ts_us - ts_us % 10000000 as window_start_us,
  case when pkt_id % 5 = 0 then 'TLS 1.3' when pkt_id % 5 = 1 then 'TLS 1.2' end as tls_version, pkt_id % 10 = 0 as has_pq, pkt_id % 7 = 0 as is_retransmit,
  case when pkt_id % 4 = 0 then size / 500 end as dns_label_entropy from conv)""", "flow_key, window_start_us", "10.0e0", True),
    _WIN_D + " tls_version_ratio avg_dns_label_entropy pq_kem_ratio retransmit_ratio"))
def flow_window18(spark, d):
    return A.flow_window_features_18(enriched_packets(spark, d))


@query("agg_group_entropy", with_("packets", """c as (select protocol, dst_port, count(*) as n from packets group by 1, 2)
 select_final protocol, sum(n)::bigint as rows, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from c group by 1""", "entropy"))
def entropy(spark, d):
    return A.group_entropy(B.packets(spark, d), ["protocol"], "dst_port")


_SEV = "case severity when 1 then 'INFO' when 2 then 'LOW' when 3 then 'MEDIUM' when 4 then 'HIGH' else 'CRITICAL' end"


@query("agg_alerts_by_severity", with_("alerts", f"select severity, count(*) as alerts, {_SEV} as label from alerts group by 1"))
def by_severity(spark, d):
    return A.alerts_by_severity(B.alerts(spark, d))


@query("agg_alerts_by_category", with_("alerts", "select category, count(*) as alerts, max(severity) as max_severity from alerts group by 1"))
def by_category(spark, d):
    return A.alerts_by_category(B.alerts(spark, d))


@query("agg_alert_rate", with_("alerts", """select ts_us - ts_us % 60000000 as window_start_us, count(*) as alerts, count(*) filter (severity >= 4) as high_or_worse from alerts group by 1"""))
def alert_rate(spark, d):
    return A.alert_rate(B.alerts(spark, d))


@query("agg_latency_percentiles", with_("ev", """l as (select list_sort(list(value)) as v, count(*) as n from ev)
 select_final n as rows, list_avg(v) as avg, v[1] as min, v[n] as max, v[1 + n // 2] as p50, v[1 + floor(n * 0.95e0)::bigint] as p95, v[1 + floor(n * 0.99e0)::bigint] as p99 from l""", "avg min max p50 p95 p99"))
def latency(spark, d):
    return A.latency_percentiles(B.events(spark, d), "value")


@query("agg_latency_histogram", with_("ev", """b as (select unnest([.00001, .00005, .0001, .0005, .001, .005, .01, .05, .1]::double[]) as b, unnest(['1.0E-5','5.0E-5','1.0E-4','5.0E-4','0.001','0.005','0.01','0.05','0.1']) as le)
 select_final le, (select count(*) from ev where value / 1000 <= b) as n from b union all select '+Inf', (select count(*) from ev)"""))
def histogram(spark, d):
    return A.latency_histogram(B.events(spark, d).withColumn("s", F.col("value") / 1000), "s")


@query("agg_score_percentiles", with_("scores", "select count(*) as rows, avg(score) as avg, min(score) as min, max(score) as max, stddev_pop(score) as std, "
       + ", ".join(f"quantile_cont(score, {p / 100}) as p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " from scores", "avg min max std p10 p25 p50 p75 p90 p95 p99"))
def score_percentiles(spark, d):
    return A.score_percentiles(B.scores(spark, d))


@query("agg_class_distribution", with_("scores", "select label, count(*) as rows, 100.0e0 * count(*) / sum(count(*)) over () as share_pct from scores group by 1", "share_pct"))
def classes(spark, d):
    return A.class_distribution(B.scores(spark, d))


@query("agg_score_separation", with_("scores", """s as (select avg(score) filter (y = 1) as attack_mean, stddev_pop(score) filter (y = 1) as attack_std,
  avg(score) filter (y = 0) as benign_mean, stddev_pop(score) filter (y = 0) as benign_std from scores)
 select_final *, attack_mean - benign_mean as gap, (attack_mean - benign_mean) / sqrt((attack_std * attack_std + benign_std * benign_std) / 2) as cohens_d,
 case when attack_mean - benign_mean > 0.01 then 'OK' when attack_mean > benign_mean then 'WEAK' else 'INVERTED' end as verdict from s""",
    "attack_mean attack_std benign_mean benign_std gap cohens_d"))
def separation(spark, d):
    return A.score_separation(B.scores(spark, d))


@query("agg_anomalous_vs_normal_means", with_("packets", " union all ".join(
    f"""select '{f}' as feature, avg({f}) filter (ttl <= 10) as anomalous_mean, avg({f}) filter (ttl > 10) as normal_mean,
 avg({f}) filter (ttl <= 10) / greatest(avg({f}) filter (ttl > 10), 1e-10) as ratio from packets""" for f in ("size", "dst_port", "tcp_flags")), "anomalous_mean normal_mean ratio"))
def means(spark, d):
    return A.anomalous_vs_normal_means(B.packets(spark, d), ["size", "dst_port", "tcp_flags"], F.col("ttl") <= 10)


_HOSTS = """select host_ip, count(*) as sessions, count(*) filter (has_pq) as pq_sessions, max(ts_us) as last_seen_us,
 count(*) filter (not has_pq) as classical_sessions, count(*) filter (has_pq) / count(*) as score from tls group by 1"""


@query("agg_pq_readiness_by_host", with_("tls", _HOSTS, "score"))
def pq_hosts(spark, d):
    return A.pq_readiness_by_host(B.tls_sessions(spark, d))


@query("agg_pq_readiness_network", with_("tls", f"""h as ({_HOSTS}) select_final count(*) as tracked_hosts, sum(sessions)::bigint as sessions,
 sum(pq_sessions)::bigint as pq_sessions, avg(score) as network_score from h""", "network_score"))
def pq_network(spark, d):
    return A.pq_readiness_network(A.pq_readiness_by_host(B.tls_sessions(spark, d)))


_RISKS = """seen as (select cipher_suite, count(*) as sessions, case when cipher_suite in (47,53,60,61,156,157) then 'CRITICAL' when cipher_suite in (4865,4866,4867) then 'SAFE' else 'AT_RISK' end as risk,
  cipher_suite in (47,53,60,61,156,157,49171,49172,49191,49192,49199,49200,49161,49162,49187,49188,49195,49196,52392,52393,4865,4866,4867) as known from tls group by 1)"""


@query("join_cipher_suite_risk", with_("tls", _RISKS + " select_final cipher_suite, sessions, risk from seen"))
def suite_risk(spark, d):
    return A.suite_risks(B.tls_sessions(spark, d), risk_dimension(spark)).select("cipher_suite", "sessions", "risk")


@query("agg_vulnerability_summary", with_("tls", _RISKS + """ select_final count(*) filter (known) as total_analyzed, count(*) filter (known and risk <> 'SAFE') as quantum_vulnerable,
 count(*) filter (known and risk = 'SAFE') as quantum_safe, count(*) filter (known and risk = 'CRITICAL') as critical from seen"""))
def vulnerability(spark, d):
    return A.vulnerability_summary(A.suite_risks(B.tls_sessions(spark, d), risk_dimension(spark)))


@query("agg_tls_posture_share", with_("tls", """p as (select case when has_pq then 'pq_safe' when tls_version = 772 or cipher_suite in (4865,4866,4867,4868) then 'moderate'
  when cipher_suite in (51,57,158) or cipher_suite >= 49152 then 'moderate' else 'weak' end as posture from tls)
 select_final posture, count(*) as sessions, 100.0e0 * count(*) / sum(count(*)) over () as share_pct from p group by 1""", "share_pct"))
def posture(spark, d):
    return A.tls_posture_share(B.tls_sessions(spark, d))
