"""Every order-dependent operator gives the same rows when its groups are cut into runs."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from packetloom.operators import aggregates as A
from packetloom.operators import detectors as D
from packetloom.operators import evaluate as E
from packetloom.operators import folds as X
from packetloom.operators import joins as J
from packetloom.operators import models as M
from packetloom.operators import windows as W
from packetloom.operators.ordered import OrderedGroups, Running, order_statistics, percentile_at, sliding_distinct, sliding_sums
from packetloom.plans import state
from packetloom.plans.detection import RULES
from packetloom.plans.sequences import rule_and_ml, squeezed_scores
from packetloom.sources import bindings as B
from packetloom.sources import sinks as K


def hot(df, column, value):
    """Move two thirds of the rows to one key."""
    return df.withColumn(column, F.when(F.xxhash64(*df.columns) % 3 != 0, F.lit(value)).otherwise(F.col(column)))


def packets(s, d):
    return hot(B.packets(s, d), "src_ip", "10.0.0.1")


def scores(s, d):
    return hot(B.scores(s, d), "flow_key", "u1")


def lone_scores(s, d):
    return B.scores(s, d).select("ts_us", "row_id", F.lit("m").alias("metric"), F.col("score").alias("value"))


def streaks(s, d):
    return W.low_streak(scores(s, d))


CASES = {
    "sliding_sums": lambda s, d, **k: sliding_sums(packets(s, d), ["src_ip"], "ts_us", "pkt_id", 20_000_000, {"n": F.lit(1), "b": F.col("size")}, **k),
    "sliding_distinct": lambda s, d, **k: sliding_distinct(packets(s, d), ["src_ip"], "ts_us", "pkt_id", "dst_port", 20_000_000, "n", **k),
    "order_statistics": lambda s, d, **k: order_statistics(scores(s, d), "score", {"p": percentile_at(0.3)}, ["flow_key"], **k),
    "flow14": lambda s, d, **k: A.flow_features_14(B.conversations_packets(s, d), None, **k),
    "flow8": lambda s, d, **k: A.flow_features_8(packets(s, d), 2, **k),
    "percentiles": lambda s, d, **k: A.score_percentiles(scores(s, d), **k),
    "latency": lambda s, d, **k: A.latency_percentiles(scores(s, d), "score", **k),
    "rolling": lambda s, d, **k: W.rolling_rate(packets(s, d), keys=["src_ip"], **k),
    "rolling_all": lambda s, d, **k: W.rolling_rate(packets(s, d), capped_by_uptime=True, **k),
    "change": lambda s, d, **k: W.value_change(packets(s, d), ["src_ip"], ["ts_us", "pkt_id"], "protocol", **k),
    "trend": lambda s, d, **k: W.score_trend(hot(squeezed_scores(s, d), "flow_key", "u1"), **k),
    "streak": lambda s, d, **k: W.low_streak(scores(s, d), **k),
    "online": lambda s, d, **k: W.online_pvalue(scores(s, d), n=30, **k),
    "replays": lambda s, d, **k: W.flag_replays(hot(B.envelopes(s, d), "sender_id", "peer-1"), **k),
    "iat": lambda s, d, **k: W.inter_arrival(packets(s, d), ["src_ip"], **k),
    "overlap": lambda s, d, **k: J.overlaps_any(B.packets(s, d).select("pkt_id", F.col("ts_us").alias("a"), (F.col("ts_us") + 999).alias("b")), "a", "b", "pkt_id", B.attack_intervals(s, d), **k),
    "correlated": lambda s, d, **k: J.correlated_alerts(*[hot(t, "flow_key", "10.0.0.1") for t in rule_and_ml(s, d)], **k),
    "before": lambda s, d, **k: J.packets_before(B.packets(s, d), B.alerts(s, d), 7, **k),
    "port_scan": lambda s, d, **k: D.port_scan(packets(s, d), D.replace(RULES, cidr_whitelist=(), **k)),
    "syn_flood": lambda s, d, **k: D.syn_flood(hot(B.packets(s, d), "dst_ip", "192.168.1.1"), D.replace(RULES, **k)),
    "brute_force": lambda s, d, **k: D.brute_force(packets(s, d), D.replace(RULES, **k)),
    "first_crossing": lambda s, d, **k: D.port_scan(packets(s, d), D.replace(RULES, cidr_whitelist=(), first_crossing=True, **k)),
    "arp_spoof": lambda s, d, **k: D.arp_spoof(hot(B.arp(s, d), "sender_ip", "10.2.0.1"), D.replace(RULES, **k)),
    "connections": lambda s, d, **k: X.tcp_connections(B.conversations_packets(s, d), 10_000_000, **k),
    "levels": lambda s, d, **k: X.threat_levels(hot(state.level_scores(s, d), "flow_key", "u1"), hot(state.forced(s, d), "flow_key", "u1"), **k),
    "incidents": lambda s, d, **k: X.incidents(hot(B.alerts(s, d), "source_ip", "10.0.0.1"), 2_000_000, **k),
    "consume": lambda s, d, **k: X.correlate_consume(*[hot(t, "flow_key", "10.0.0.1") for t in rule_and_ml(s, d)], **k),
    "cooldown": lambda s, d, **k: X.cooldown(hot(B.alerts(s, d).withColumnRenamed("alert_id", "seq"), "source_ip", "10.0.0.1"), ["source_ip"], 5.0, **k),
    "bucket": lambda s, d, **k: X.token_bucket(hot(B.envelopes(s, d), "sender_id", "peer-1"), ["sender_id"], 0.5, 3, ("recv_ts_us", "env_id"), **k),
    "contamination": lambda s, d, **k: X.adaptive_contamination(
        scores(s, d).select(F.lit("d").alias("detector"), "ts_us", "row_id", (F.col("score") > 0.2).cast("int").alias("y")), scores(s, d), **k),
    "dynamic": lambda s, d, **k: X.dynamic_pvalue(streaks(s, d), size=50, chunk_rows=100, **k),
    "conformal": lambda s, d, **k: M.conformal_pvalues(scores(s, d).filter("y = 0"), scores(s, d), **k),
    "ks": lambda s, d, **k: M.ks_drift(scores(s, d).filter("y = 0"), scores(s, d).filter("y = 1"), **k),
    "contamination_threshold": lambda s, d, **k: E.contamination_threshold(scores(s, d), **k),
    "ewma": lambda s, d, **k: X.ewma_zscore(lone_scores(s, d).drop("row_id"), **k),
    "ewma_prior": lambda s, d, **k: X.ewma_zscore(lone_scores(s, d).drop("row_id"), 0.02, 7, "prior", **k),
    "hinkley": lambda s, d, **k: X.page_hinkley(scores(s, d).withColumnRenamed("flow_key", "detector"), ("detector",), 0.001, 0.4, 0.05, 40.0, ("ts_us", "row_id"), **k),
    "hybrid": lambda s, d, **k: M.hybrid_score(scores(s, d).withColumn("max_z", F.col("score") * 4), **k),
    "chain": lambda s, d, **k: K.audit_chain(B.alerts(s, d).select(F.lit("log").alias("log_id"), "ts_us", F.col("alert_id").alias("row_id"), F.col("description").alias("payload")), "g", 50, **k),
}


@pytest.mark.parametrize("name", CASES)
def test_cut_groups_give_the_same_rows(spark, sf, name):
    plain = rows(CASES[name](spark, sf, hot_rows=False))
    cut = rows(CASES[name](spark, sf, hot_rows=True, parts=6))
    assert plain and plain == cut


def test_small_chunks_of_a_cut_group(spark, sf):
    groups = OrderedGroups(scores(spark, sf), ["flow_key"], ["ts_us", "row_id"], True, 5)
    cut = groups.over_last(9, lambda w: {"s": F.sum("score").over(w.rowsBetween(-8, 0))}, chunk_rows=10)
    plain = OrderedGroups(scores(spark, sf), ["flow_key"], ["ts_us", "row_id"], False).over_last(
        9, lambda w: {"s": F.sum("score").over(w.rowsBetween(-8, 0))})
    assert rows(plain) == rows(cut)


def test_automatic_check_finds_the_hot_group(spark, sf):
    df = packets(spark, sf)
    assert OrderedGroups(df, ["src_ip"], ["ts_us", "pkt_id"], 100).split
    assert not OrderedGroups(df, ["src_ip"], ["ts_us", "pkt_id"], 10_000).split
    n = OrderedGroups(df, ["src_ip"], ["ts_us", "pkt_id"], 100).running(n=Running("sum", F.lit(1))).df
    assert n.agg(F.max("n")).first()[0] == df.groupBy("src_ip").count().agg(F.max("count")).first()[0]
