"""Queries with joins, sliding windows and per-key sequences."""

from pyspark.sql import functions as F

from packetloom.functions.tls import risk_dimension
from packetloom.operators import joins as J
from packetloom.operators import windows as W
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.sources import bindings as B

# ---- joins ----------------------------------------------------------------------------------

_IP = "(split_part({c}, '.', 1)::bigint * 16777216 + split_part({c}, '.', 2)::bigint * 65536 + split_part({c}, '.', 3)::bigint * 256 + split_part({c}, '.', 4)::bigint)"
_NETS = ["10.0.0.0/27", "10.0.0.96/28", "192.168.1.0/30"]
_IN_NETS = f"""({_IP.format(c='src_ip')} between 167772160 and 167772191 or {_IP.format(c='src_ip')} between 167772256 and 167772271)"""

query("join_cidr_anti", with_("packets", f"select pkt_id, src_ip from packets where not {_IN_NETS}"))(
    lambda s, d: J.in_ranges(B.packets(s, d), F.col("src_ip"), J.cidr_ranges(s, _NETS), "left_anti").select("pkt_id", "src_ip"))
query("join_cidr_semi", with_("packets", f"select pkt_id, src_ip from packets where {_IN_NETS}"))(
    lambda s, d: J.in_ranges(B.packets(s, d), F.col("src_ip"), J.cidr_ranges(s, _NETS), "left_semi").select("pkt_id", "src_ip"))


def geo_ranges(spark, d):
    """Five addresses per nation in 52.10.0.0/24."""
    lo = (52 * 16777216 + 10 * 65536 + F.col("n_nationkey") * 5).cast("bigint")
    nation, region = B.table(spark, d, "nation"), B.table(spark, d, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(  # 5 regions
        lo.alias("lo"), (lo + 4).alias("hi"), F.col("r_name").alias("country"), F.col("n_name").alias("city"))


@query("join_geo", with_("packets", f"""p as (select pkt_id, case when pkt_id % 3 = 0 then dst_ip else replace(src_ip, '10.0.0.', '52.10.0.') end as ip from packets),
 g as (select 52::bigint * 16777216 + 10 * 65536 + n_nationkey * 5 as lo, r_name as country, n_name as city from nation join region on n_regionkey = r_regionkey)
 select_final pkt_id, ip, case when ip like '192.168.%' then 'Private' else coalesce(country, 'Unknown') end as country,
 case when ip like '192.168.%' then 'LAN' else coalesce(city, 'Unknown') end as city from p left join g on {_IP.format(c='ip')} between lo and lo + 4"""))
def geo(spark, d):
    ip = F.when(F.col("pkt_id") % 3 == 0, F.col("dst_ip")).otherwise(F.regexp_replace("src_ip", r"^10\.0\.0\.", "52.10.0."))
    return J.geo_enriched(B.packets(spark, d).select("pkt_id", ip.alias("ip")), "ip", geo_ranges(spark, d))


@query("join_label_by_interval", with_("packets spans", """select pkt_id, ts_us, coalesce((select label from spans where ts_us between start_us and end_us order by start_us limit 1), 'BENIGN') as label from packets"""))
def label_interval(spark, d):
    return J.label_by_interval(B.packets(spark, d).select("pkt_id", "ts_us"), "ts_us", B.attack_intervals(spark, d), "pkt_id")


@query("join_interval_overlap", with_("packets spans", """w as (select ts_us // 1000000 as id, min(ts_us) as a, max(ts_us) as b from packets group by 1)
 select_final id, a, b, case when exists (select 1 from spans where a <= end_us and start_us <= b) then 1 else 0 end as y from w"""))
def overlap(spark, d):
    w = B.packets(spark, d).groupBy(F.floor(F.col("ts_us") / 1000000).alias("id")).agg(
        F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    return J.overlaps_any(w, "a", "b", "id", B.attack_intervals(spark, d))


def rule_and_ml(spark, d):
    rules = B.alerts(spark, d).select(F.col("source_ip").alias("flow_key"), "ts_us", F.col("alert_id").alias("seq"), "category", "confidence")
    ml = B.ml_alerts(spark, d).select("flow_key", "ts_us", F.col("ml_id").alias("seq"), "anomaly_score", "detector_type")
    return rules, ml


ARRIVALS_SQL = """u as (select source_ip as flow_key, ts_us, 0 as kind, alert_id as seq, category, confidence, null::double as score from alerts
  union all select flow_key, ts_us, 1, ml_id, null, null, anomaly_score from ml),
 v as (select *, last_value(case when kind = 0 then ts_us end ignore nulls) over w as rule_ts_us, last_value(category ignore nulls) over w as rcat, last_value(confidence ignore nulls) over w as rconf,
   last_value(case when kind = 1 then ts_us end ignore nulls) over w as ml_ts_us, last_value(score ignore nulls) over w as mscore
  from u window w as (partition by flow_key order by ts_us, kind, seq rows between unbounded preceding and current row))"""
_MATCH_COLS = """flow_key, ts_us, kind, seq, rule_ts_us, rcat as category, rconf as rule_confidence, ml_ts_us, mscore as ml_score, 'iforest' as detector_type,
 1 - (1 - rconf) * (1 - mscore) as joint_confidence"""
_MATCH_D = "rule_confidence ml_score joint_confidence"


@query("join_rule_ml_interval", with_("alerts ml", ARRIVALS_SQL + f" select_final {_MATCH_COLS} from v where abs(rule_ts_us - ml_ts_us) <= 3000000", _MATCH_D))
def rule_ml(spark, d):
    return J.correlated_alerts(*rule_and_ml(spark, d), window_us=3_000_000)


def with_reasons(spark, d):
    """The same alerts with evidence, technique and deviations."""
    factor = lambda m, o, t, w: F.struct(F.lit(m).alias("metric"), o.cast("string").alias("observed"), F.lit(t).alias("threshold"), F.lit(w).alias("weight"))
    a = B.alerts(spark, d)
    rules = a.select(F.col("source_ip").alias("flow_key"), "ts_us", F.col("alert_id").alias("seq"), "category", "confidence",
                     F.array(factor("port", F.col("dest_port"), "threshold: 25", 0.6), factor("severity", F.col("severity"), None, 0.4)).alias("evidence"),
                     F.concat(F.lit("T"), F.col("severity").cast("string")).alias("mitre_ref"))
    ml = B.ml_alerts(spark, d)
    off = F.create_map(F.lit("score"), F.col("anomaly_score") * 4 - 2, F.lit("half"), F.col("anomaly_score") / 2, F.lit("age"), (F.col("ml_id") % 7 - 3).cast("double"),
                       F.lit("none"), F.lit(None).cast("double"), F.lit("turn"), (3 - F.col("ml_id") % 7).cast("double"))
    return rules, ml.select("flow_key", "ts_us", F.col("ml_id").alias("seq"), "anomaly_score", "detector_type", off.alias("importances"))


@query("join_cross_layer", with_("alerts ml", ARRIVALS_SQL + """, cl as (select v.*, last_value(case when kind = 1 then seq end ignore nulls) over w as ml_id, last_value(case when kind = 0 then seq end ignore nulls) over w as rule_id
   from v window w as (partition by flow_key order by ts_us, kind, seq rows between unbounded preceding and current row)),
 cm as (select cl.flow_key, cl.ts_us, cl.kind, cl.seq, dest_port, severity, mscore, ml_id from cl join alerts on alert_id = rule_id where abs(rule_ts_us - ml_ts_us) <= 3000000),
 ce as (select flow_key, ts_us, kind, seq, unnest(['score', 'half', 'age', 'turn']) as f, unnest([mscore * 4 - 2, mscore / 2, ml_id % 7 - 3.0e0, 3.0e0 - ml_id % 7]) as x from cm),
 cr as (select *, row_number() over (partition by flow_key, ts_us, kind, seq order by abs(x) desc, f) as i from ce),
 cg as (select flow_key, ts_us, kind, seq, string_agg(f, ',' order by i) as features, arg_min(x, i) as furthest from cr where i <= 3 group by all)
 select_final flow_key, ts_us, kind, seq, features, furthest, 'port ' || dest_port || ' (threshold: 25); severity ' || severity as seen, 'T' || severity as technique from cm join cg using (flow_key, ts_us, kind, seq)""", "furthest"))
def cross_layer(spark, d):
    out = J.cross_layer(J.correlated_alerts(*with_reasons(spark, d), window_us=3_000_000))
    seen = F.regexp_extract("cross_layer", "\n  seen: ([^\n]*)\n", 1)
    technique = F.regexp_extract("cross_layer", "\nrule [^\n]*, (T[0-9])\n", 1)
    return out.select("flow_key", "ts_us", "kind", "seq", F.array_join(F.transform("top_features", lambda e: e["key"]), ",").alias("features"),
                      F.col("top_features")[0]["value"].alias("furthest"), seen.alias("seen"), technique.alias("technique"))


@query("join_packets_before_alert", with_("packets alerts", """n as (select pkt_id, ts_us, row_number() over (order by ts_us, pkt_id) as rn from packets),
 a as (select alert_id, (select count(*) from packets p where p.ts_us <= alerts.ts_us) as last from alerts where severity >= 4)
 select_final alert_id, pkt_id, ts_us, last - rn + 1 as age from a join n on rn between last - 19 and last"""))
def evidence(spark, d):
    return J.packets_before(B.packets(spark, d), B.alerts(spark, d), n=20)


@query("join_category_dims", with_("alerts", """select alert_id, category, case category when 'PORT_SCAN' then 'T1046' when 'SYN_FLOOD' then 'T1498.001' when 'DNS_TUNNEL' then 'T1071.004' when 'DNS_EXFIL' then 'T1048.003'
 when 'DNS_FLOOD' then 'T1071.004' when 'ARP_SPOOF' then 'T1557.002' when 'BRUTE_FORCE' then 'T1110' when 'TTL_ANOMALY' then 'T1090.003' when 'PROTO_ANOMALY' then 'T1036' else 'T1095' end as technique,
 concat_ws('; ', case when severity >= 4 then 'contain ' else 'watch ' end || source_ip, case when severity >= 3 then 'examine ' || dest_ip || ':' || dest_port end,
  case when severity >= 5 then 'page the officer on duty' end, 'compare with ' || technique) as actions,
 case dest_port when 21 then 'FTP' when 22 then 'SSH' when 23 then 'Telnet' else dest_port::varchar end as service from alerts"""))
def dims(spark, d):
    return J.with_category_dims(B.alerts(spark, d)).select(
        "alert_id", "category", F.split("mitre_ref", " - ")[0].alias("technique"), F.array_join("response_actions", "; ").alias("actions"), "service")


@query("join_cipher_suites_left", with_("tls", """select sess_id, cipher_suite in (47,53,60,61,156,157,49171,49172,49191,49192,49199,49200,49161,49162,49187,49188,49195,49196,52392,52393,4865,4866,4867) as known from tls"""))
def suites(spark, d):
    s = B.tls_sessions(spark, d)
    return s.join(F.broadcast(risk_dimension(spark)), F.col("cipher_suite") == F.col("suite_id"), "left").select(
        "sess_id", F.col("suite_id").isNotNull().alias("known"))


# ---- windows --------------------------------------------------------------------------------

@query("win_rolling_rate", with_("packets", """t as (select ts_us, count(*) as n, sum(size)::bigint as b from packets group by 1)
 select_final ts_us, sum(n) over w::bigint as packets, sum(b) over w::bigint as bytes, sum(n) over w / 5.0e0 as packets_per_second, sum(b) over w / 5.0e0 as bytes_per_second
 from t window w as (order by ts_us range between 4999999 preceding and current row)""", "packets_per_second bytes_per_second"))
def rolling(spark, d):
    return W.rolling_rate(B.packets(spark, d))


@query("win_rolling_rate_uptime", with_("packets", """t as (select ts_us, count(*) as n, sum(size)::bigint as b from packets group by 1),
 s as (select *, greatest(least(5.0e0, (ts_us - min(ts_us) over ()) / 1e6), 0.001e0) as e from t)
 select_final ts_us, sum(n) over w::bigint as packets, sum(b) over w::bigint as bytes, sum(n) over w / e as packets_per_second, sum(b) over w / e as bytes_per_second
 from s window w as (order by ts_us range between 4999999 preceding and current row)""", "packets_per_second bytes_per_second"))
def rolling_uptime(spark, d):
    return W.rolling_rate(B.packets(spark, d), capped_by_uptime=True)


@query("win_rolling_rate_by_source", with_("packets", """t as (select src_ip, ts_us, count(*) as n, sum(size)::bigint as b from packets group by 1, 2)
 select_final src_ip, ts_us, sum(n) over w::bigint as packets, sum(b) over w::bigint as bytes, sum(n) over w / 20.0e0 as packets_per_second, sum(b) over w / 20.0e0 as bytes_per_second
 from t window w as (partition by src_ip order by ts_us range between 19999999 preceding and current row)""", "packets_per_second bytes_per_second"))
def rolling_source(spark, d):
    return W.rolling_rate(B.packets(spark, d), 20_000_000, keys=["src_ip"])


@query("win_top_connections", with_("packets", f"""select concat(src_ip, ':', src_port, '<->', dst_ip, ':', dst_port) as connection, sum(size) / 5.0e0 as bytes_per_second
 from packets where ts_us > {B.EPOCH_US} + 95000000 and ts_us <= {B.EPOCH_US} + 100000000 group by 1 order by 2 desc, 1 limit 10""", "bytes_per_second"))
def top_conn(spark, d):
    return W.top_connections(B.packets(spark, d), F.lit(B.EPOCH_US + 100_000_000))


@query("win_sliding_count", with_("packets", """select pkt_id, src_ip, ts_us, (select count(*) from packets q where q.src_ip = p.src_ip and q.ts_us > p.ts_us - 10000000
 and (q.ts_us < p.ts_us or (q.ts_us = p.ts_us and q.pkt_id <= p.pkt_id))) as n from packets p"""))
def sliding_count(spark, d):
    from packetloom.operators.ordered import sliding_sums
    p = B.packets(spark, d).select("pkt_id", "src_ip", "ts_us")
    return sliding_sums(p, ["src_ip"], "ts_us", "pkt_id", 10_000_000, {"n": F.lit(1)})


@query("win_sliding_distinct", with_("packets", """select p.pkt_id, p.src_ip, p.ts_us, count(distinct q.dst_port) as n from packets p join packets q on q.src_ip = p.src_ip and q.ts_us > p.ts_us - 10000000
 and (q.ts_us < p.ts_us or (q.ts_us = p.ts_us and q.pkt_id <= p.pkt_id)) group by 1, 2, 3"""))
def sliding_distinct(spark, d):
    from packetloom.operators.ordered import sliding_distinct as distinct
    p = B.packets(spark, d).select("pkt_id", "src_ip", "ts_us", "dst_port")
    return distinct(p, ["src_ip"], "ts_us", "pkt_id", "dst_port", 10_000_000, "n").drop("dst_port")


@query("win_value_change", with_("packets", """v as (select src_ip, pkt_id, protocol, lag(protocol) over (partition by src_ip order by ts_us, pkt_id) as previous_value from packets)
 select_final * from v where protocol <> previous_value"""))
def value_change(spark, d):
    p = B.packets(spark, d).select("src_ip", "ts_us", "pkt_id", "protocol")
    return W.value_change(p, ["src_ip"], ["ts_us", "pkt_id"], "protocol").drop("ts_us")


@query("win_pq_trend", with_("tls", """r as (select host_ip, has_pq, row_number() over (partition by host_ip order by ts_us desc, sess_id desc) as rn from tls),
 g as (select host_ip, least(count(*), 20) as n, count(*) filter (has_pq and rn <= 10) as recent_pq, count(*) filter (has_pq and rn between 11 and 20) as previous_pq from r group by 1)
 select_final host_ip, recent_pq, previous_pq, case when n < 10 then 'UNKNOWN' when n < 20 then case when recent_pq >= 5 then 'IMPROVING' else 'STABLE' end
 when recent_pq - previous_pq >= 2 then 'IMPROVING' when recent_pq - previous_pq <= -2 then 'DEGRADING' else 'STABLE' end as trend from g"""))
def pq_trend(spark, d):
    return W.pq_trend(B.tls_sessions(spark, d))


def squeezed_scores(spark, d):
    """Scores on the packet clock, so that slopes per second have a size."""
    squeezed = (B.EPOCH_US + F.floor((F.col("ts_us") - B.EPOCH_US) / B.SQUEEZE)).cast("bigint")
    return B.scores(spark, d).withColumn("ts_us", squeezed)


_TREND = """sq as (select * replace (cast(1704067200000000 + floor((ts_us - 1704067200000000) / 8640) as bigint) as ts_us) from scores),
 tr as (select row_id, flow_key, ts_us, score, y, label, case when count(*) over w < 2 then 0 else coalesce(regr_slope(score, (ts_us - 1704067200000000) / 1e6) over w, 0) end as trend,
  avg(score) over w as mean_score, max(score) over w as max_score, case when count(*) over w < 2 then 0 else var_pop(score) over w end as variance,
  avg(score) over (partition by flow_key order by ts_us, row_id rows 2 preceding) as recent_mean, count(*) over w as buffer_size
  from sq window w as (partition by flow_key order by ts_us, row_id rows 9 preceding))"""
_TREND_D = "score trend mean_score max_score variance recent_mean"


@query("win_score_trend", with_("scores", _TREND + " select_final * from tr", _TREND_D))
def trend(spark, d):
    return W.score_trend(squeezed_scores(spark, d))


@query("win_trend_alerts", with_("scores", _TREND + " select_final * from tr where buffer_size >= 3 and trend > 0.004 and mean_score > 0.15", _TREND_D))
def trend_alerts(spark, d):
    return W.trend_alerts(W.score_trend(squeezed_scores(spark, d)), slope=0.004, mean=0.15)


@query("win_top_trending", with_("scores", _TREND + """, l as (select * from tr qualify row_number() over (partition by flow_key order by ts_us desc, row_id desc) = 1)
 select_final * from l where buffer_size >= 3 order by trend desc, flow_key limit 10""", _TREND_D))
def top_trending(spark, d):
    return W.top_trending(W.score_trend(squeezed_scores(spark, d)))


@query("win_low_streak", with_("scores", """s as (select *, sum(case when score >= 0.35 then 1 else 0 end) over (partition by flow_key order by ts_us, row_id) as island from scores)
 select_final row_id, flow_key, case when score >= 0.35 then 0 else row_number() over (partition by flow_key, island order by ts_us, row_id)
  - case when island > 0 then 1 else 0 end end as streak from s"""))
def low_streak(spark, d):
    return W.low_streak(B.scores(spark, d)).select("row_id", "flow_key", "streak")


@query("win_online_pvalue", with_("scores", """n as (select *, row_number() over (partition by flow_key order by ts_us, row_id) as rn from scores),
 c as (select a.row_id, a.flow_key, count(b.row_id) as m, count(b.row_id) filter (b.score >= a.score) as ge from n a left join n b on a.flow_key = b.flow_key and b.rn between a.rn - 50 and a.rn - 1 group by 1, 2)
 select_final row_id, flow_key, (ge + 1) / (m + 1) as p_value, m as calibration_size, (ge + 1) / (m + 1) <= 0.05 as is_anomaly from c""", "p_value"))
def online(spark, d):
    return W.online_pvalue(B.scores(spark, d), n=50).select("row_id", "flow_key", "p_value", "calibration_size", "is_anomaly")


@query("win_flag_replays", with_("env", """f as (select *, greatest(coalesce(max(case when abs(recv_ts_us - sent_ts_us) <= 30000000 then seq end)
   over (partition by sender_id order by recv_ts_us, env_id rows between unbounded preceding and 1 preceding), 0), 0) as last_seq from env)
 select_final *, case when seq <= last_seq then 'REPLAY' when abs(recv_ts_us - sent_ts_us) > 30000000 then 'STALE' else 'ACCEPTED' end as verdict from f"""))
def replays(spark, d):
    return W.flag_replays(B.envelopes(spark, d))


@query("win_inter_arrival", with_("packets", "select pkt_id, src_ip, (ts_us - lag(ts_us) over (partition by src_ip order by ts_us, pkt_id)) / 1e6 as iat from packets", "iat"))
def inter_arrival(spark, d):
    return W.inter_arrival(B.packets(spark, d).select("pkt_id", "src_ip", "ts_us"), ["src_ip"]).select("pkt_id", "src_ip", "iat")


query("win_recent_dns", with_("dns", "select q_id, ts_us, src_ip, name from dns order by ts_us desc, q_id desc limit 20"))(
    lambda s, d: W.recent_log(B.dns_queries(s, d).select("q_id", "ts_us", "src_ip", "name"), 20, seq="q_id"))
query("win_recent_alerts", with_("alerts", "select alert_id, ts_us, category from alerts where severity >= 3 order by ts_us desc, alert_id desc limit 50"))(
    lambda s, d: W.recent_log(B.alerts(s, d).filter("severity >= 3").select("alert_id", "ts_us", "category"), 50, seq="alert_id"))
