"""Queries with order-dependent state, and the audit chain built on the same fold."""

from pyspark.sql import functions as F

from packetloom.operators import folds as X
from packetloom.operators import windows as W
from packetloom.operators.windows import low_streak
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.plans.sequences import _MATCH_COLS, _MATCH_D, ARRIVALS_SQL, rule_and_ml
from packetloom.sources import bindings as B
from packetloom.sources import sinks

# ---- smoothed baselines -----------------------------------------------------------------------


def node_series(spark, d):
    """Packets and bytes per second of every sensor: one point per second, whatever the load."""
    per = B.packets(spark, d).groupBy("node_id", (F.floor(F.col("ts_us") / 1000000) * 1000000).alias("ts_us")).agg(
        F.count(F.lit(1)).cast("double").alias("packets"), F.sum("size").cast("double").alias("bytes"))
    pairs = F.array(F.struct(F.concat("node_id", F.lit("/packets_per_sec")).alias("metric"), F.col("packets").alias("value")),
                    F.struct(F.concat("node_id", F.lit("/bytes_per_sec")).alias("metric"), F.col("bytes").alias("value")))
    return per.select("ts_us", F.explode(pairs).alias("p")).select("p.metric", "ts_us", "p.value")


_SERIES = """ps as (select node_id, ts_us - ts_us % 1000000 as ts_us, count(*)::double as p, sum(size)::double as b from packets group by 1, 2),
 ms as (select concat(node_id, '/packets_per_sec') as metric, ts_us, p as value from ps union all select concat(node_id, '/bytes_per_sec'), ts_us, b from ps),
 mn as (select *, row_number() over (partition by metric order by ts_us) as rn from ms),
 w as (select metric, avg(value) as m, var_samp(value) as v from mn where rn <= 20 group by 1),
 r as (select mn.metric, 20::bigint as rn, ts_us, value, m, v, m as pm, v as pv from mn join w using (metric) where rn = 20
  union all select n.metric, n.rn, n.ts_us, n.value, r.m + 0.1e0 * (n.value - r.m), 0.9e0 * (r.v + 0.1e0 * (n.value - r.m) * (n.value - r.m)), r.m, r.v from r join mn n on n.metric = r.metric and n.rn = r.rn + 1)"""
_Z = "case when sqrt(greatest({v}, 0)) >= 1e-10 then (value - {m}) / sqrt({v}) end"


@query("fold_ewma_zscore", with_("packets", _SERIES + f""" select_final metric, ts_us, value, m as mean, sqrt(v) as std, {_Z.format(m='m', v='v')} as z from r
 union all select metric, ts_us, value, value, 0, null from mn where rn < 20""", "value mean std z", recursive=True))
def ewma(spark, d):
    return X.ewma_zscore(node_series(spark, d))


@query("fold_ewma_zscore_prior", with_("packets", _SERIES + f""" select_final metric, ts_us, value, m as mean, sqrt(v) as std, case when rn = 20 then {_Z.format(m='m', v='v')} else {_Z.format(m='pm', v='pv')} end as z from r
 union all select metric, ts_us, value, value, 0, null from mn where rn < 20""", "value mean std z", recursive=True))
def ewma_prior(spark, d):
    return X.ewma_zscore(node_series(spark, d), against="prior")


_HITS = _SERIES + f""", zs as (select metric, ts_us, value, case when rn = 20 then {_Z.format(m='m', v='v')} else {_Z.format(m='pm', v='pv')} end as z from r),
 h as (select *, row_number() over (partition by metric order by ts_us) as i from zs where abs(z) >= 1.5),
 k as (select metric, ts_us, value, z, i, ts_us as kept, true as keep from h where i = 1
  union all select h.metric, h.ts_us, h.value, h.z, h.i, case when h.ts_us - k.kept >= 10000000 then h.ts_us else k.kept end, h.ts_us - k.kept >= 10000000 from k join h on h.metric = k.metric and h.i = k.i + 1)"""


@query("fold_ewma_alerts", with_("packets", _HITS + """ select_final metric, ts_us, value, z, case when abs(z) >= 5 then 5 when abs(z) >= 4 then 4 when abs(z) >= 3 then 3 else 2 end as severity,
 case when z > 0 then 'spike' else 'drop' end as direction, least(1, abs(z) / 6) as confidence from k where keep""", "value z confidence", recursive=True))
def ewma_alerts(spark, d):
    z = X.ewma_zscore(node_series(spark, d), against="prior").select("metric", "ts_us", "value", "z")
    return X.ewma_alerts(z, threshold=1.5)


@query("fold_ewma_baselines", with_("packets", _SERIES + """ select_final metric, max(rn) as samples, arg_max(m, rn) as mean, sqrt(arg_max(v, rn)) as std, true as warmed_up from r group by 1""", "mean std", recursive=True))
def baselines(spark, d):
    return X.ewma_baselines(X.ewma_zscore(node_series(spark, d)))


@query("fold_cooldown", with_("alerts", """h as (select alert_id as seq, ts_us, source_ip, row_number() over (partition by source_ip order by ts_us, alert_id) as i from alerts),
 k as (select seq, ts_us, source_ip, i, ts_us as kept, true as keep from h where i = 1
  union all select h.seq, h.ts_us, h.source_ip, h.i, case when h.ts_us - k.kept >= 20000000 then h.ts_us else k.kept end, h.ts_us - k.kept >= 20000000 from k join h on h.source_ip = k.source_ip and h.i = k.i + 1)
 select_final seq, ts_us, source_ip from k where keep""", recursive=True))
def cooldown(spark, d):
    a = B.alerts(spark, d).select(F.col("alert_id").alias("seq"), "ts_us", "source_ip")
    return X.cooldown(a, ["source_ip"], 20.0)


# ---- connections ------------------------------------------------------------------------------

_CONN = """t0 as (select *, case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port else dst_ip || ':' || dst_port || '|' || src_ip || ':' || src_port end as fk from conv where protocol = 'TCP'),
 t1 as (select *, row_number() over w as rn, coalesce(ts_us - lag(ts_us) over w > 10000000, false) as paused, tcp_flags & 1 > 0 as f, tcp_flags & 2 > 0 as s, tcp_flags & 4 > 0 as r, tcp_flags & 16 > 0 as a from t0 window w as (partition by fk order by ts_us, pkt_id)),
 st as (select fk, rn, 1 as c, case when r then 'RESET' when s and not a then 'SYN_SENT' when s and a then 'SYN_RECEIVED' when f then 'FIN_WAIT' else 'NEW' end as q from t1 where rn = 1
  union all select n.fk, n.rn, p.c + case when n.paused or p.q in ('RESET', 'CLOSED') then 1 else 0 end,
   case when n.r then 'RESET' when n.s and not n.a then 'SYN_SENT' when n.s and n.a then 'SYN_RECEIVED'
    when n.paused or p.q in ('RESET', 'CLOSED') then case when n.f then 'FIN_WAIT' else 'NEW' end
    when n.a and p.q = 'SYN_RECEIVED' then 'ESTABLISHED' when n.f then case when p.q = 'FIN_WAIT' then 'CLOSED' else 'FIN_WAIT' end else p.q end
  from st p join t1 n on n.fk = p.fk and n.rn = p.rn + 1),
 j as (select t1.*, st.c, st.q, max(st.c) over (partition by fk) as newest, first_value(src_ip) over (partition by fk, st.c order by rn) as o_ip, first_value(src_port) over (partition by fk, st.c order by rn) as o_port,
  first_value(dst_ip) over (partition by fk, st.c order by rn) as p_ip, first_value(dst_port) over (partition by fk, st.c order by rn) as p_port from t1 join st using (fk, rn)),
 cx as (select o_ip as src_ip, o_port as src_port, p_ip as dst_ip, p_port as dst_port, c::bigint as connection, case when c < newest and arg_max(q, rn) not in ('RESET', 'CLOSED') then 'CLOSED' else arg_max(q, rn) end as state,
  min(ts_us) as start_us, max(ts_us) as last_seen_us, count(*) as packets, coalesce(sum(size) filter (src_ip = o_ip and src_port = o_port), 0)::bigint as bytes_sent, coalesce(sum(size) filter (not (src_ip = o_ip and src_port = o_port)), 0)::bigint as bytes_recv
  from j group by fk, c, newest, o_ip, o_port, p_ip, p_port)"""


def connections(spark, d):
    return X.tcp_connections(B.conversations_packets(spark, d), idle_us=10_000_000).drop("sni", "ja3")


query("fold_tcp_connections", with_("conv", _CONN + " select_final * from cx", recursive=True))(connections)
query("agg_flow_state_counts", with_("conv", _CONN + " select_final state, count(*) as connections from cx group by 1", recursive=True))(
    lambda s, d: X.flow_state_counts(connections(s, d)))
query("agg_active_flows", with_("conv", _CONN + """ select_final * from cx where state in ('NEW', 'SYN_SENT', 'SYN_RECEIVED', 'ESTABLISHED')
 order by last_seen_us desc, src_ip, src_port, dst_ip, dst_port limit 50""", recursive=True))(lambda s, d: X.active_flows(connections(s, d)))

# ---- threat levels ----------------------------------------------------------------------------


def level_scores(spark, d):
    return B.scores(spark, d).withColumn("score", F.least(F.lit(1.0), F.col("score") * 3))


def forced(spark, d):
    return B.scores(spark, d).filter("row_id % 97 = 0").select("flow_key", "ts_us", "row_id")


_LEVELS = """li as (select flow_key, ts_us, row_id, least(1.0e0, score * 3) as score, 0 as forced from scores {forced}),
 l0 as (select *, row_number() over (partition by flow_key order by ts_us, forced, row_id) as rn from li),
 l1 as (select flow_key, 0::bigint as rn, 0 as old, 0 as lv, 0 as cn, 0 as ce from (select distinct flow_key from l0)
  union all select flow_key, rn, old, up, case when up <> old then 0 else cn end, case when up <> old then 0 else ce end from (
   select n.flow_key, n.rn, p.lv as old, case when n.forced = 1 then p.cn when n.score < 0.25 then p.cn + 1 else 0 end as cn, case when n.forced = 1 then p.ce when n.score >= 0.35 then p.ce + 1 else 0 end as ce,
    case when n.forced = 1 then 3 when n.score < 0.25 and p.cn + 1 >= 3 and p.lv > 0 then 0 when p.lv = 0 and n.score >= 0.35 then 1
     when p.lv = 1 and (n.score >= 0.55 or (n.score >= 0.35 and p.ce + 1 >= 2)) then 2 when p.lv = 2 and n.score >= 0.75 then 3 else p.lv end as up
   from l1 p join l0 n on n.flow_key = p.flow_key and n.rn = p.rn + 1)),
 lx as (select l0.flow_key, ts_us, row_id, score, forced, (['BASELINE','WATCH','SUSPECT','HOSTILE'])[old + 1] as from_level, (['BASELINE','WATCH','SUSPECT','HOSTILE'])[lv + 1] as to_level, ([30,15,10,5])[lv + 1] as window_s from l0 join l1 using (flow_key, rn))"""
_L = _LEVELS.format(forced="")
_LF = _LEVELS.format(forced="union all select flow_key, ts_us, row_id, null, 1 from scores where row_id % 97 = 0")

query("fold_threat_levels", with_("scores", _L + " select_final * from lx", "score", recursive=True))(lambda s, d: X.threat_levels(level_scores(s, d)))
query("fold_threat_levels_forced", with_("scores", _LF + " select_final * from lx", "score", recursive=True))(
    lambda s, d: X.threat_levels(level_scores(s, d), forced(s, d)))
query("fold_threat_level_summary", with_("scores", _LF + """, la as (select flow_key, arg_max(to_level, (ts_us, forced, row_id)) as level from lx group by 1)
 select_final level, count(*) as flows from la group by 1""", recursive=True))(lambda s, d: X.threat_level_summary(X.threat_levels(level_scores(s, d), forced(s, d))))
query("fold_recent_transitions", with_("scores", _LF + """ select_final *, case when forced = 1 then 'correlated alert' when to_level = 'BASELINE' then 'three normal windows'
 when to_level = 'SUSPECT' and score < 0.55 then 'two elevated windows' else 'score over threshold' end as reason from lx where from_level <> to_level order by ts_us desc, row_id desc, forced desc limit 20""", "score", recursive=True))(
    lambda s, d: X.recent_transitions(X.threat_levels(level_scores(s, d), forced(s, d))))

# ---- incidents --------------------------------------------------------------------------------

_INC = """i0 as (select *, case when ts_us - lag(ts_us) over w <= 20000000 then 0 else 1 end as fresh from alerts window w as (partition by source_ip order by ts_us, alert_id)),
 i1 as (select *, sum(fresh) over (partition by source_ip order by ts_us, alert_id)::bigint as session from i0),
 i2 as (select source_ip, session, count(*) as alerts, min(ts_us) as first_seen_us, max(ts_us) as last_seen_us, max(severity) as worst, arg_min(severity, (ts_us, alert_id)) as opening, list(distinct category) as cs from i1 group by 1, 2),
 i3 as (select source_ip, session, list(category order by fa) as categories from (select source_ip, session, category, min((ts_us, alert_id)) as fa from i1 group by 1, 2, 3) group by 1, 2),
 i4 as (select *, case when list_has_all(cs, ['PORT_SCAN','BRUTE_FORCE']) then 'recon_to_exploit' when list_has_all(cs, ['PORT_SCAN','SYN_FLOOD','DNS_TUNNEL']) then 'scan_flood_tunnel'
   when list_has_all(cs, ['PORT_SCAN','DNS_TUNNEL']) then 'recon_to_c2' when list_has_all(cs, ['BRUTE_FORCE','DNS_EXFIL']) then 'brute_to_exfil' when list_has_all(cs, ['SYN_FLOOD','ICMP_TUNNEL']) then 'flood_tunnel' end as attack_chain from i2),
 i5 as (select i4.*, i3.categories, case when alerts >= 2 and attack_chain is not null then 5 when alerts >= 3 then greatest(worst, 4) when alerts = 2 then greatest(worst, 3) else worst end as severity from i4 join i3 using (source_ip, session)),
 inc as (select source_ip, session, alerts, first_seen_us, last_seen_us, categories, attack_chain, severity, severity > opening as escalated, (last_seen_us - first_seen_us) / 1e6 as duration from i5)"""


def incidents(spark, d):
    return X.incidents(B.alerts(spark, d), gap_us=20_000_000)


query("fold_incidents", with_("alerts", _INC + " select_final * from inc", "duration"))(lambda s, d: incidents(s, d).drop("chain_description"))
query("join_chain_containment", with_("alerts", _INC + " select_final source_ip, session, attack_chain from inc where attack_chain is not null"))(
    lambda s, d: incidents(s, d).filter("attack_chain is not null").select("source_ip", "session", "attack_chain"))
_NOW = B.EPOCH_US + 300_000_000
query("fold_incident_stats", with_("alerts", _INC + f""" select_final count(*) as total_incidents, count(*) filter (last_seen_us >= {_NOW} - 20000000) as active_incidents,
 count(*) filter (last_seen_us < {_NOW} - 20000000) as completed_incidents, count(*) filter (escalated) as escalated from inc"""))(
    lambda s, d: X.incident_stats(incidents(s, d), _NOW, 20_000_000))
query("fn_incident_summary", with_("alerts", _INC + """ select_final source_ip, session, concat(alerts, ' alerts from ', source_ip, ' (', list_aggregate(categories, 'string_agg', ', '), ')',
 case attack_chain when 'recon_to_exploit' then ' [Ports were probed, then passwords tried]' when 'scan_flood_tunnel' then ' [Probing, a flood and a DNS tunnel in turn]' when 'recon_to_c2' then ' [Ports were probed, then a DNS tunnel opened]'
  when 'brute_to_exfil' then ' [Passwords were tried, then data left through DNS]' when 'flood_tunnel' then ' [A flood covers an ICMP tunnel]' else '' end,
 ' [', (['INFO','LOW','MEDIUM','HIGH','CRITICAL'])[severity], ']') as summary from inc"""))(
    lambda s, d: X.incident_summary(incidents(s, d)).select("source_ip", "session", "summary"))


@query("fold_correlate_consume", with_("alerts ml", ARRIVALS_SQL + f""", v2 as (select *, row_number() over (partition by flow_key order by ts_us, kind, seq) as rn from v),
 cc as (select flow_key, 0::bigint as rn, false as ra, false as ma, false as hit from (select distinct flow_key from v2)
  union all select flow_key, rn, ra2 and not h, ma2 and not h, h from (select n.flow_key, n.rn, p.ra or n.kind = 0 as ra2, p.ma or n.kind = 1 as ma2,
    (p.ra or n.kind = 0) and (p.ma or n.kind = 1) and coalesce(abs(n.rule_ts_us - n.ml_ts_us) <= 3000000, false) as h from cc p join v2 n on n.flow_key = p.flow_key and n.rn = p.rn + 1))
 select_final {_MATCH_COLS} from v2 join cc using (flow_key, rn) where hit""", _MATCH_D, recursive=True))
def consume(spark, d):
    return X.correlate_consume(*rule_and_ml(spark, d), window_us=3_000_000)


# ---- drift, contamination, calibration ----------------------------------------------------------


def window_series(spark, d):
    """Mean score per sensor label and hour: the series a drift detector watches."""
    hour = (F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(3_600_000_000))).alias("ts_us")
    return B.scores(spark, d).groupBy(F.col("label").alias("detector"), hour).agg(F.avg("score").alias("score"))


_HOURS = """hs as (select label as detector, ts_us - ts_us % 3600000000 as ts_us, avg(score) as score from scores group by 1, 2),
 hn as (select *, row_number() over (partition by detector order by ts_us) as rn from hs)"""


@query("fold_page_hinkley", with_("scores", _HOURS + """, ph as (select detector, rn, ts_us, score, 1 as n, score as mean, 0.0e0 as total, 0.0e0 as low, 0.0e0 as deviation, false as drift from hn where rn = 1
  union all select detector, rn, ts_us, score, case when n = 1 then 1 when dev > 0.3 then 0 else n end, mean, total, low, dev, dev > 0.3 from (
   select *, total - low as dev from (select *, case when n = 1 then 0.0e0 else least(low0, total) end as low from (
    select h.detector, h.rn, h.ts_us, h.score, p.n + 1 as n, case when p.n = 0 then h.score else 0.01e0 * h.score + 0.99e0 * p.mean end as mean,
     case when p.n = 0 then 0.0e0 else p.total + h.score - (0.01e0 * h.score + 0.99e0 * p.mean) - 0.01e0 end as total, p.low as low0
    from ph p join hn h on h.detector = p.detector and h.rn = p.rn + 1))))
 select_final detector, ts_us, score, deviation, drift from ph""", "score deviation", recursive=True))
def page_hinkley(spark, d):
    return X.page_hinkley(window_series(spark, d), threshold=0.3)


@query("fold_adaptive_contamination", with_("scores", """a0 as (select label as detector, row_number() over w as n, avg(case when score >= 0.2 then 1.0e0 else 0 end) over (partition by label order by ts_us, row_id rows 99 preceding) as detection_rate from scores window w as (partition by label order by ts_us, row_id)),
 a1 as (select detector, n, detection_rate, n // 50 as k from a0 where n % 50 = 0),
 a2 as (select detector, 0::bigint as k, null::bigint as n, null::double as detection_rate, null::double as old_contamination, 0.1e0 as contamination from (select distinct detector from a1)
  union all select a1.detector, a1.k, a1.n, a1.detection_rate, a2.contamination, greatest(0.01, least(0.3, 0.15e0 * a1.detection_rate + 0.85e0 * a2.contamination)) from a2 join a1 on a1.detector = a2.detector and a1.k = a2.k + 1),
 tv as (select list_sort(list(score)) as v from scores where y = 0),
 a3 as (select detector, n, detection_rate, old_contamination, contamination, (len(v) - 1) * (1 - contamination) as p, v from a2, tv where k > 0)
 select_final detector, n, detection_rate, old_contamination, contamination, v[floor(p)::bigint + 1] + (v[ceil(p)::bigint + 1] - v[floor(p)::bigint + 1]) * (p - floor(p)) as threshold from a3""",
    "detection_rate old_contamination contamination threshold", recursive=True))
def contamination(spark, d):
    s = B.scores(spark, d)
    preds = s.select(F.col("label").alias("detector"), "ts_us", "row_id", (F.col("score") >= 0.2).cast("int").alias("y"))
    return X.adaptive_contamination(preds, s.filter("y = 0").select("score"))


@query("fold_dynamic_pvalue", with_("scores", """d0 as (select *, sum(case when score >= 0.35 then 1 else 0 end) over (partition by flow_key order by ts_us, row_id) as island from scores),
 d1 as (select *, case when score >= 0.35 then 0 else row_number() over (partition by flow_key, island order by ts_us, row_id) - case when island > 0 then 1 else 0 end end as streak from d0),
 d2 as (select *, coalesce(sum(case when streak >= 3 then 1 else 0 end) over (order by ts_us, row_id rows between unbounded preceding and 1 preceding), 0) as c from d1),
 d3 as (select c + 1 as i, score from d2 where streak >= 3),
 d4 as (select a.row_id, count(b.i) as m, count(b.i) filter (b.score >= a.score) as ge from d2 a left join d3 b on b.i > a.c - 1000 and b.i <= a.c group by 1)
 select_final row_id, (ge + 1) / (m + 1) as p_value, m as calibration_size, m > 0 and (ge + 1) / (m + 1) <= 0.05 as is_anomaly from d4""", "p_value"))
def dynamic(spark, d):
    streaks = low_streak(B.scores(spark, d))
    return X.dynamic_pvalue(streaks, chunk_rows=2000).select("row_id", "p_value", "calibration_size", "is_anomaly")


_BUCKET = """b0 as (select *, row_number() over (partition by sender_id order by recv_ts_us, env_id) as rn from env),
 b1 as (select env_id, sender_id, recv_ts_us, rn, true as allowed, 1.0e0 as tokens from b0 where rn = 1
  union all select env_id, sender_id, recv_ts_us, rn, t >= 1, case when t >= 1 then t - 1 else t end from (select n.env_id, n.sender_id, n.recv_ts_us, n.rn, least(2.0e0, p.tokens + (n.recv_ts_us - p.recv_ts_us) / 1e6 * 0.2e0) as t from b1 p join b0 n on n.sender_id = p.sender_id and n.rn = p.rn + 1))"""


@query("fold_token_bucket", with_("env", _BUCKET + """
 select_final env_id, sender_id, allowed, tokens from b1""", "tokens", recursive=True))
def bucket(spark, d):
    r = B.envelopes(spark, d).select("env_id", "sender_id", "recv_ts_us")
    return X.token_bucket(r, ["sender_id"], rate=0.2, burst=2, order=("recv_ts_us", "env_id")).select("env_id", "sender_id", "allowed", "tokens")


# ---- liveness, eviction, audit chain -------------------------------------------------------------

query("fold_node_liveness", with_("beats", f"""select node_id, max(ts_us) as last_us, arg_max(uptime, (ts_us, packets_sent)) as uptime, arg_max(packets_sent, (ts_us, packets_sent)) as packets_sent,
 case when {_NOW} - max(ts_us) > 5000000 then 'OFFLINE' else 'ONLINE' end as status from beats group by 1""", "uptime"))(
    lambda s, d: X.node_liveness(B.heartbeats(s, d), F.lit(_NOW), 5_000_000))
query("fold_evict_stale", with_("packets", f"""l as (select src_ip, max(ts_us) as last_us from packets group by 1) select_final * from l where {_NOW} - last_us <= 2000000"""))(
    lambda s, d: X.evict_stale(B.packets(s, d).groupBy("src_ip").agg(F.max("ts_us").alias("last_us")), "last_us", F.lit(_NOW), 2.0))

GENESIS = "packetloom audit v1"
_CHAIN = f"""lg as (select concat('log-', source_ip) as log_id, concat(category, '|', alert_id) as payload, row_number() over (partition by source_ip order by ts_us, alert_id) - 1 as rn from alerts),
 ln as (select log_id, rn // 10 as segment, rn % 10 + 1 as seq, payload from lg),
 lc as (select log_id, segment, 0::bigint as seq, '' as payload, sha256('{GENESIS}') as hash from (select distinct log_id, segment from ln)
  union all select n.log_id, n.segment, n.seq, n.payload, sha256(concat(c.hash, n.payload)) from lc c join ln n on n.log_id = c.log_id and n.segment = c.segment and n.seq = c.seq + 1),
 lt as (select log_id, segment, max(seq) as n, arg_max(hash, seq) as tail from lc group by 1, 2),
 sl as (select log_id, -1::bigint as segment, sha256('{GENESIS}') as seal from (select distinct log_id from lt)
  union all select t.log_id, t.segment, sha256(concat(s.seal, t.tail, 'SESSION_CLOSED|', t.tail, '|', t.n)) from sl s join lt t on t.log_id = s.log_id and t.segment = s.segment + 1),
 chain as (select * from lc where seq > 0 union all select log_id, segment, n + 1, concat('SESSION_CLOSED|', tail, '|', n), seal from lt join sl using (log_id, segment)
  union all select log_id, max(segment) + 1, 1, concat('LOG_CLOSED|', count(*), '|', sum(n)), sha256(concat(arg_max(seal, segment), 'LOG_CLOSED|', count(*), '|', sum(n))) from lt join sl using (log_id, segment) group by log_id)"""


def chain(spark, d):
    log = B.alerts(spark, d).select(F.concat(F.lit("log-"), "source_ip").alias("log_id"), "ts_us", F.col("alert_id").alias("row_id"),
                                    F.concat_ws("|", "category", F.col("alert_id").cast("string")).alias("payload"))
    return sinks.audit_chain(log, GENESIS, segment_rows=10)


query("sink_audit_chain", with_("alerts", _CHAIN + " select_final * from chain", recursive=True))(chain)


@query("win_verify_audit_chain", with_("alerts", _CHAIN + """ select_final log_id, segment, count(*) as links, count(*) filter (seq = 2)::bigint as broken_links, 0::bigint as gaps, true as complete, count(*) filter (seq = 2) = 0 as intact from chain group by 1, 2""", recursive=True))
def verify(spark, d):
    """Every second payload was tampered with, which must show as one broken link per segment."""
    tampered = chain(spark, d).withColumn("payload", F.when(F.col("seq") == 2, "forged").otherwise(F.col("payload")))
    return W.verify_audit_chain(tampered, GENESIS)
