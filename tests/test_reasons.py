"""Explanations, playbooks, statistics and feedback on small tables."""

from helpers import rows
from pyspark.sql import functions as F

from packetloom.operators import detectors as D
from packetloom.operators import folds as X
from packetloom.operators import joins as J
from packetloom.operators import models as M
from packetloom.operators import windows as W

EVIDENCE = "array<struct<metric: string, observed: string, threshold: string, weight: double>>"


def matches(spark, evidence, importances, mitre="T1"):
    rules = spark.createDataFrame([("f", 1_000_000, 1, "PORT_SCAN", 0.5, evidence, mitre)],
                                  f"flow_key string, ts_us long, seq long, category string, confidence double, evidence {EVIDENCE}, mitre_ref string")
    ml = spark.createDataFrame([("f", 2_000_000, 2, 0.8, "iforest", importances)],
                               "flow_key string, ts_us long, seq long, anomaly_score double, detector_type string, importances map<string, double>")
    return J.cross_layer(J.correlated_alerts(rules, ml))


def test_both_layers_give_their_reasons(spark):
    seen = [("ports", "20", "threshold: 15", 0.5), ("probes", "40", None, 0.3), ("method", None, None, 0.2), ("fourth", "x", None, 0.0)]
    row = matches(spark, seen, {"a": 1.0, "b": -3.25, "c": 0.5, "d": 1.0, "e": None}).first()
    assert row.cross_layer == ("f: two layers agree, joint confidence 90.0%\nrule PORT_SCAN at 50.0%, T1\n  seen: ports 20 (threshold: 15); probes 40; method ?\n"
                               "model iforest with score 0.800\n  off: b -3.3 sd, a +1.0 sd, d +1.0 sd")
    assert [e.key for e in row.top_features] == ["b", "a", "d"] and len(row.top_evidence) == 3


def test_missing_reasons(spark):
    row = matches(spark, None, None, None).first()
    assert row.cross_layer == "f: two layers agree, joint confidence 90.0%\nrule PORT_SCAN at 50.0%, no technique\nmodel iforest with score 0.800"
    assert row.top_features == [] and row.top_evidence == []


def test_a_playbook_replaces_the_derived_actions(spark):
    alerts = spark.createDataFrame([("PORT_SCAN", 5, "1.1.1.1", "2.2.2.2", 22), ("SYN_FLOOD", 2, "1.1.1.1", None, None)],
                                   "category string, severity int, source_ip string, dest_ip string, dest_port int")
    book = spark.createDataFrame([("SYN_FLOOD", ["call me"])], "category string, response_actions array<string>")
    own = {r.category: r.response_actions for r in J.with_category_dims(alerts, book).collect()}
    assert own == {"PORT_SCAN": ["contain 1.1.1.1", "examine 2.2.2.2:22", "page the officer on duty", "compare with T1046"], "SYN_FLOOD": ["call me"]}


def test_keys_to_cut_in_one_pass(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("b"))
    cases = {"a": (F.lit(True), ["a"]), "b": (F.lit(True), ["b"]), "few": (F.col("a") == 3, ["b"]), "none": (F.col("a") > 50, ["a"])}
    assert D.keys_to_cut(df, cases, 500) == {"a": False, "b": True, "few": False, "none": False}
    assert D.keys_to_cut(df.limit(0), cases, 0) == dict.fromkeys(cases, False)


def test_false_alarms_move_the_threshold(spark):
    scores = [0.8, 0.8, 0.8, 0.8, 0.6, 0.1, 0.1, 0.2, 0.9, 0.9, 0.9, 0.9]  # up to HOSTILE, back, and up again
    df = spark.createDataFrame([("f", k, k, s) for k, s in enumerate(scores)], "flow_key string, ts_us long, row_id long, score double")
    levels = X.threat_levels(df)
    hostile = [r for r in levels.orderBy("ts_us").collect() if r.from_level == "HOSTILE"]
    alarms = M.false_alarms(levels)
    assert rows(alarms) == rows(M.false_alarms(levels, hot_rows=True, parts=3))
    got = alarms.first()
    assert (alarms.count(), got.score, got.row_id) == (1, 0.2, 7) and got.windows == len([r for r in hostile if r.row_id <= 7])
    p = M.conformal_with_feedback(df.limit(3), alarms, df.select("row_id", "score"))
    assert p.first().calibration_size == 3 + got.windows


def test_ranked_p_values_with_nulls_and_ties(spark):
    values = [0.5, 0.5, None, 0.1, 0.9, 0.5, None, 0.5]
    df = spark.createDataFrame([("f", k, k, v) for k, v in enumerate(values)], "flow_key string, ts_us long, row_id long, score double")
    got = [(r.p_value, r.calibration_size) for r in W.online_pvalue(df, n=3).orderBy("row_id").collect()]
    want = []
    for k, v in enumerate(values):
        prior = [x for x in values[max(0, k - 3) : k] if x is not None]
        want.append(((sum(x >= v for x in prior if v is not None) + 1) / (len(prior) + 1), len(prior)))
    assert got == want
