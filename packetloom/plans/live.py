"""Streaming queries: the given tables land as files, a stream drains them into a table."""

import math

from pyspark.sql import functions as F

from packetloom.operators import aggregates as A
from packetloom.operators import models as M
from packetloom.plans.inputs import scratch
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.plans.sequences import _MATCH_COLS, _MATCH_D, ARRIVALS_SQL, rule_and_ml
from packetloom.plans.state import _BUCKET, _CONN, _L, _SERIES, _Z, level_scores, node_series
from packetloom.plans.traffic import _FLOW14_D, _FLOW14_SQL, _WIN_D, _feature_sql
from packetloom.sources import bindings as B
from packetloom.sources import packets as P
from packetloom.streaming import streams as X


def live(spark, df):
    """Write a table as files and read it back as a stream."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


#: Rows a file of a landed batch holds, more or less.
FILE_ROWS = 250_000


def in_turn(spark, *tables, batches=4, late=None, file_rows=FILE_ROWS):
    """Streams of one micro-batch for each of ``batches`` equal spans of time. One row in ten of the last five seconds
    of a span comes with the next one only, and the rows ``late`` chooses with the last one.

    Every batch of a table lands as equally many files, written in parallel; where there are fewer, files without rows
    make up the number, so that a micro-batch never takes files of the next span.
    """
    low, high = tables[0].select("ts_us").unionByName(tables[-1].select("ts_us")).agg(F.min("ts_us"), F.max("ts_us")).first()
    streams = []
    for df in tables:
        path, span = scratch(spark), (high - low) / batches
        at = F.least(F.floor((F.col("ts_us") - low) / span), F.lit(batches - 1))
        slow = (F.col("ts_us") % 10 == 0) & (F.col("ts_us") - low >= (at + 1) * span - 5_000_000) & (at < batches - 1)
        at = F.when(F.lit(False) if late is None else late, batches - 1).otherwise(at + slow.cast("int"))
        files = max(1, math.ceil(df.count() / batches / file_rows))
        nothing = spark.createDataFrame([], df.schema).coalesce(1)
        for k in range(batches):
            df.filter(at == k).coalesce(files).write.mode("append").parquet(path)
            for _ in range((k + 1) * files - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
                nothing.write.mode("append").parquet(path)
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path))
    return streams[0] if len(streams) == 1 else streams


def closed(ts, last):
    """Rows whose second the last watermark has passed."""
    return f"(({ts}) // 1000000 + 1) * 1000 <= (({last}) - 10000000) // 1000"


def drained(spark, stream, mode="append"):
    return X.run_to_table(stream, scratch(spark), scratch(spark), mode)


_END = "(select max(ts_us) - 10000000 from packets)"


@query("stream_window_features", with_("packets", "t as (" + with_("packets", _feature_sql(
    "x as (select *, ts_us - ts_us % 30000000 as window_start_us from packets)", "window_start_us", "30.0e0"), _WIN_D)
    + f") select_final * from t where window_start_us + 30000000 <= {_END}"))
def windows(spark, d):
    return drained(spark, X.stream_window_features(live(spark, B.packets(spark, d))))


@query("stream_flow_features", with_("conv packets", "t as (" + with_("conv", _FLOW14_SQL.format(start="ts_us - ts_us % 30000000", least=2), _FLOW14_D)
       + f") select_final * from t where window_start_us + 30000000 <= {_END}"))
def flows(spark, d):
    return drained(spark, X.stream_flow_features(live(spark, B.conversations_packets(spark, d))))


@query("stream_sliding_counts", with_("packets", f"""s as (select dst_ip, ts_us, unnest([0, 1, 2, 3, 4]) as j from packets where tcp_flags & 2 > 0 and tcp_flags & 16 = 0),
 w as (select dst_ip, ts_us - ts_us % 2000000 - j * 2000000 as window_start_us from s)
 select_final dst_ip, window_start_us, count(*) as n from w where window_start_us + 10000000 <= (select max(ts_us) - 10000000 from packets where tcp_flags & 2 > 0 and tcp_flags & 16 = 0) group by 1, 2"""))
def sliding(spark, d):
    syn = F.col("tcp_flags").bitwiseAND(2).cast("boolean") & (F.col("tcp_flags").bitwiseAND(16) == 0)
    return drained(spark, X.stream_sliding_counts(live(spark, B.packets(spark, d)), ["dst_ip"], 10, syn))


@query("stream_incidents", with_("alerts", """i0 as (select *, case when ts_us - lag(ts_us) over w <= 20000000 then 0 else 1 end as fresh from alerts window w as (partition by source_ip order by ts_us, alert_id)),
 i1 as (select *, sum(fresh) over (partition by source_ip order by ts_us, alert_id) as session from i0),
 i2 as (select source_ip, count(*) as alerts, min(ts_us) as first_seen_us, max(ts_us) as last_seen_us, max(severity) as worst, list_sort(list(distinct category)) as categories from i1 group by source_ip, session),
 i4 as (select *, case when list_has_all(categories, ['PORT_SCAN','BRUTE_FORCE']) then 'recon_to_exploit' when list_has_all(categories, ['PORT_SCAN','SYN_FLOOD','DNS_TUNNEL']) then 'scan_flood_tunnel'
   when list_has_all(categories, ['PORT_SCAN','DNS_TUNNEL']) then 'recon_to_c2' when list_has_all(categories, ['BRUTE_FORCE','DNS_EXFIL']) then 'brute_to_exfil' when list_has_all(categories, ['SYN_FLOOD','ICMP_TUNNEL']) then 'flood_tunnel' end as attack_chain from i2)
 select_final source_ip, alerts, first_seen_us, last_seen_us, categories, attack_chain, case when alerts >= 2 and attack_chain is not null then 5 when alerts >= 3 then greatest(worst, 4) when alerts = 2 then greatest(worst, 3) else worst end as severity
 from i4 where (last_seen_us + 20000001) // 1000 <= (select (max(ts_us) - 10000000) // 1000 from alerts)"""))
def incidents(spark, d):
    a = B.alerts(spark, d).select("alert_id", "ts_us", "source_ip", "severity", "category")
    return drained(spark, X.stream_incidents(live(spark, a), gap_s=20))


@query("stream_alert_rate", with_("alerts", """select ts_us - ts_us % 60000000 as window_start_us, count(*) as alerts, count(*) filter (severity >= 4) as high_or_worse from alerts
 group by 1 having ts_us - ts_us % 60000000 + 60000000 <= (select max(ts_us) - 10000000 from alerts)"""))
def alert_rate(spark, d):
    return drained(spark, X.stream_alert_rate(in_turn(spark, B.alerts(spark, d).select("alert_id", "ts_us", "severity"))))


@query("src_packet_stream", with_("packets", "select pkt_id, ts_us, node_id, src_ip, dst_ip, src_port, dst_port, protocol, size, tcp_flags, ttl from packets"))
def packet_stream(spark, d):
    """Packets land as files of several sensors and are drained batch by batch."""
    path = scratch(spark)
    packets = B.packets(spark, d).select(*P.PACKETS.fieldNames())
    packets.repartition(4, "node_id").write.parquet(path)
    return drained(spark, P.packet_stream(spark, path, files_per_trigger=2)).select(
        "pkt_id", "ts_us", "node_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size", "tcp_flags", "ttl")


@query("stream_correlated", with_("alerts ml", ARRIVALS_SQL + f" select_final {_MATCH_COLS} from v where abs(rule_ts_us - ml_ts_us) <= 3000000 and {closed('ts_us', 'select max(ts_us) from v')}", _MATCH_D))
def correlated(spark, d):
    rules, ml = rule_and_ml(spark, d)
    return drained(spark, X.stream_correlated(*in_turn(spark, rules, ml), window_s=3))


@query("stream_threat_levels", with_("scores", _L + f" select_final flow_key, ts_us, row_id, from_level, to_level from lx where {closed('ts_us', 'select max(ts_us) from scores')}", recursive=True))
def levels(spark, d):
    return drained(spark, X.stream_threat_levels(in_turn(spark, level_scores(spark, d)), ttl_s=86_400 * 40))


@query("stream_tcp_states", with_("conv", _CONN + f" select_final src_ip, src_port, dst_ip, dst_port, pkt_id, ts_us, q as state from j where {closed('ts_us', 'select max(ts_us) from t0')}", recursive=True))
def tcp(spark, d):
    packets = B.conversations_packets(spark, d)
    states = drained(spark, X.stream_tcp_states(in_turn(spark, packets.filter("protocol = 'TCP'")), 10_000_000))
    return states.join(packets.select("pkt_id", "src_ip", "src_port", "dst_ip", "dst_port"), "pkt_id").select(
        "src_ip", "src_port", "dst_ip", "dst_port", "pkt_id", "ts_us", "state")


@query("stream_ewma", with_("packets", _SERIES + f""" select_final metric, ts_us, value, m as mean, sqrt(v) as std, {_Z.format(m='m', v='v')} as z from r
 union all select metric, ts_us, value, value, 0, null from mn where rn < 20""".replace("from r\n", f"from r where {closed('ts_us', 'select max(ts_us) from mn')}\n") + f" and {closed('ts_us', 'select max(ts_us) from mn')}", "value mean std z", recursive=True))
def ewma(spark, d):
    return drained(spark, X.stream_ewma(in_turn(spark, node_series(spark, d))))


@query("stream_flag_replays", with_("env", """f as (select *, greatest(coalesce(max(case when abs(recv_ts_us - sent_ts_us) <= 30000000 then seq end)
   over (partition by sender_id order by recv_ts_us, env_id rows between unbounded preceding and 1 preceding), 0), 0) as last_seq from env)
 select_final sender_id, recv_ts_us as ts_us, seq, case when seq <= last_seq then 'REPLAY' when abs(recv_ts_us - sent_ts_us) > 30000000 then 'STALE' else 'ACCEPTED' end as verdict from f where """ + closed("recv_ts_us", "select max(recv_ts_us) from env")))
def replays(spark, d):
    e = B.envelopes(spark, d).withColumnRenamed("recv_ts_us", "ts_us")
    return drained(spark, X.stream_flag_replays(in_turn(spark, e).withColumnRenamed("ts_us", "recv_ts_us"))).select("sender_id", "ts_us", "seq", "verdict")


@query("stream_token_bucket", with_("env", _BUCKET + f" select_final env_id as seq, sender_id, allowed, tokens from b1 where {closed('recv_ts_us', 'select max(recv_ts_us) from env')}", "tokens", recursive=True))
def bucket(spark, d):
    r = B.envelopes(spark, d).select("sender_id", F.col("recv_ts_us").alias("ts_us"), F.col("env_id").alias("seq"))
    return drained(spark, X.stream_token_bucket(in_turn(spark, r), ["sender_id"], 0.2, 2)).select("seq", "sender_id", "allowed", "tokens")


@query("stream_value_change", with_("arp", """av as (select *, lag(sender_mac) over (partition by sender_ip order by ts_us, arp_id) as previous_value from arp where opcode = 2)
 select_final sender_ip, arp_id, previous_value, sender_mac from av where previous_value <> sender_mac and """ + closed("ts_us", "select max(ts_us) from arp where opcode = 2")))
def changes(spark, d):
    a = B.arp(spark, d).filter("opcode = 2").select("arp_id", "ts_us", "sender_ip", "sender_mac")
    return drained(spark, X.stream_value_change(in_turn(spark, a), ["sender_ip"], "sender_mac", ("ts_us", "arp_id"))).select("sender_ip", "arp_id", "previous_value", "sender_mac")


_SPANS = """lo as (select min(ts_us) as t0, max(ts_us) - min(ts_us) as d from arp where opcode = 2),
 sp as (select arp.*, least(floor((ts_us - t0) / (d / 4)), 3) as k, arp_id % 97 = 0 as held from arp, lo where opcode = 2),
 lt as (select * from sp where held and k < 3 and """ + closed("ts_us", "select max(ts_us) from sp where not held and k < 3") + ")"


@query("stream_dead_letters", with_("arp", _SPANS + " select_final sender_ip, arp_id, ts_us, sender_mac from lt"))
def dead_letters(spark, d):
    """Rows that come when their second is closed already: none is lost and none changes a fold."""
    a = B.arp(spark, d).filter("opcode = 2").select("arp_id", "ts_us", "sender_ip", "sender_mac")
    stream = in_turn(spark, a, late=(F.col("arp_id") % 97 == 0))
    fold = X.stream_fold(stream, ["sender_ip"], ["sender_mac"], lambda last, now: (now, (last,)), "previous_value string", "last string",
                         order=("ts_us", "arp_id"), late=True)
    folded, late = scratch(spark), scratch(spark)
    X.start(X.with_dead_letters(fold, folded, late, scratch(spark)).trigger(availableNow=True)).awaitTermination()
    return spark.read.schema(fold.schema).parquet(late).select("sender_ip", "arp_id", "ts_us", "sender_mac")


@query("stream_node_liveness", with_("beats", f"""bl as (select *, lag(ts_us) over w as before, lead(ts_us) over w as after from beats window w as (partition by node_id order by ts_us, packets_sent)),
 bc as (select * from bl where {closed('ts_us', 'select max(ts_us) from beats')})
 select_final node_id, 'ONLINE' as status, ts_us as at_us from bc where before is null or ts_us - before > 1000000
 union all select node_id, 'OFFLINE', ts_us + 1000000 from bl where coalesce(after - ts_us > 1000000, true) and {closed('ts_us + 1000000', 'select max(ts_us) from beats')}"""))
def liveness(spark, d):
    return drained(spark, X.stream_node_liveness(in_turn(spark, B.heartbeats(spark, d)), 1))


@query("stream_metrics", with_("packets", "select ts_us // 1000000 as second, protocol, count(*) as packets, sum(size)::bigint as bytes from packets group by 1, 2"))
def metrics(spark, d):
    path = scratch(spark)
    X.stream_metrics(live(spark, B.packets(spark, d)), path, scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return X.read_metrics(spark, path)


@query("stream_score")
def score(spark, d):
    w = A.window_features_14(B.packets(spark, d), 2 * A.SECOND)
    stats = M.fit_zscore(w, A.WINDOW14)
    forest = M.fit_forest(M.with_vector(M.apply_zscore(w, stats, A.WINDOW14), A.WINDOW14), "window_start_us", trees=25)
    row = stats.first()
    known = {n: (row[f"mean_{n}"], row[f"std_{n}"]) for n in A.WINDOW14}
    closed = X.stream_window_features(live(spark, B.packets(spark, d)), seconds=2)
    return drained(spark, X.stream_score(closed, known, forest).drop("features")).select("window_start_us", "score", "predicted")
