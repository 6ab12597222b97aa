"""Rule detectors on literal packets: published quality figures and boundary cases."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from packetloom.operators import detectors as D
from packetloom.operators import evaluate as E
from packetloom.operators import folds as X
from packetloom.operators import joins as J
from packetloom.operators import windows as W

SEC = 1_000_000
OPEN = D.Rules(cidr_whitelist=(), domain_whitelist=(), multicast=())
PACKET = "pkt_id bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size bigint, tcp_flags int, ttl int"


def packet(i, ts, src="10.0.0.1", dst="10.0.9.9", dport=80, flags=2, ttl=64, protocol="TCP"):
    return (i, ts, src, dst, 40000, dport, protocol, 60, flags, ttl)


def labelled_traffic():
    """759 packets inside one second, counted by category."""
    tcp, dns, arp, icmp, labels, n = [], [], [], [], [], 0

    def add(label, table, make):
        nonlocal n
        n += 1
        labels.append((n, label))
        table.append(make(n, n * 1000))

    first, second = "192.168.0.1", "192.168.0.2"
    for s in range(3):
        for p in range(24):
            add("PORT_SCAN", tcp, lambda i, t: packet(i, t, f"10.1.0.{s}", first, 1000 + p))
    for target in (first, second):
        for k in range(250):
            add("SYN_FLOOD", tcp, lambda i, t: packet(i, t, f"10.2.{k}.{target[-1]}", target, 80))
    for k in range(5):
        add("DNS_TUNNEL", dns, lambda i, t: (i, t, "10.3.0.1", "abcdefghijklmnopqrstuvwxyz0123456789ABCD.evil.com", False))
    for k in range(3):
        add("BENIGN", arp, lambda i, t: (i, t, 2, f"aa:{k}", f"10.4.0.{k}"))
    for k in range(3):
        add("ARP_SPOOF", arp, lambda i, t: (i, t, 2, f"bb:{k}", f"10.4.0.{k}"))
    for s in range(2):
        for k in range(20):
            add("BRUTE_FORCE", tcp, lambda i, t: packet(i, t, f"10.5.0.{s}", "192.168.0.9", 22))
    for k in range(3):
        add("ICMP_TUNNEL", icmp, lambda i, t: (i, t, "10.6.0.1", "192.168.0.9", bytes(range(200))))
    for k in range(3):
        add("PROTO_ANOMALY", tcp, lambda i, t: packet(i, t, f"10.7.0.{k}", first, 80, 3))
    for k in range(4):
        add("BENIGN", dns, lambda i, t: (i, t, "10.8.0.1", "stackoverflow.com", False))
    for k in range(126):
        add("BENIGN", tcp, lambda i, t: packet(i, t, f"10.9.0.{k}", "192.168.0.8", 443, 16))
    return tcp, dns, arp, icmp, labels


@pytest.mark.parametrize("level, expected", [
    ("medium", {"PORT_SCAN": (30, 42, 0), "SYN_FLOOD": (374, 126, 3), "BRUTE_FORCE": (22, 18, 0), "DNS_TUNNEL": (5, 0, 0),
                "DNS_EXFIL": (0, 0, 5), "ARP_SPOOF": (3, 0, 0), "ICMP_TUNNEL": (3, 0, 0), "PROTO_ANOMALY": (3, 0, 0), "OVERALL": (440, 186, 8)}),
    ("high", {"PORT_SCAN": (51, 21, 0), "SYN_FLOOD": (451, 49, 26), "BRUTE_FORCE": (32, 8, 0), "DNS_TUNNEL": (5, 0, 4),
              "DNS_EXFIL": (0, 0, 5), "OVERALL": (548, 78, 35)}),
])
def test_published_quality(spark, level, expected):
    tcp, dns, arp, icmp, labels = labelled_traffic()
    assert len(labels) == 759
    alerts = D.detect_all(
        spark.createDataFrame(tcp, PACKET), spark.createDataFrame(dns, "q_id bigint, ts_us bigint, src_ip string, name string, is_response boolean"),
        spark.createDataFrame(arp, "arp_id bigint, ts_us bigint, opcode int, sender_mac string, sender_ip string"),
        spark.createDataFrame(icmp, "icmp_id bigint, ts_us bigint, src_ip string, dst_ip string, payload binary"), level, OPEN)
    quality = E.rule_quality(spark.createDataFrame(labels, "pkt_id bigint, label string"), alerts)
    found = {r.category: (r.tp, r.fn, r.fp) for r in quality.collect()}
    assert {k: found[k] for k in expected} == expected
    overall = quality.filter("category = 'OVERALL'").first()
    published = {"medium": (98.2, 70.3, 81.9), "high": (94.0, 87.5, 90.7)}[level]
    assert tuple(round(100 * overall[m], 1) for m in ("precision", "recall", "f1")) == published


def scan(spark, times, **rules):
    p = spark.createDataFrame([packet(i, t, dport=100 + i) for i, t in enumerate(times)], PACKET)
    return sorted(r.seq for r in D.port_scan(p, replace(OPEN, **rules)).collect())


def test_event_at_the_cutoff_is_outside(spark):
    assert scan(spark, [0, 10 * SEC], port_scan=2) == []
    assert scan(spark, [1, 10 * SEC], port_scan=2) == [1]


def test_ties_count_in_arrival_order(spark):
    assert scan(spark, [5, 5, 5], port_scan=2) == [1, 2]
    assert scan(spark, [5, 5, 5, 5], port_scan=2, first_crossing=True) == [1]


def test_whitelisted_source_is_not_reported(spark):
    assert scan(spark, [1, 2, 3], port_scan=2, cidr_whitelist=("10.0.0.0/30",)) == []
    assert scan(spark, [1, 2, 3], port_scan=2, cidr_whitelist=("10.0.0.2/31", "bad" and "11.0.0.0/8")) == [1, 2]


def test_xmas_reading(spark):
    p = spark.createDataFrame([packet(1, 1, flags=24), packet(2, 2, flags=41)], PACKET)
    loose = {r.pkt_id: r.scan_type for r in D.scan_probes(p, OPEN).collect()}
    strict = {r.pkt_id: r.scan_type for r in D.scan_probes(p, replace(OPEN, strict_xmas=True)).collect()}
    assert loose == {1: "XMAS", 2: "XMAS"} and strict == {2: "XMAS"}


ALERT = "alert_id bigint, ts_us bigint, severity int, category string, source_ip string"


def test_incident_gap_is_inclusive(spark):
    a = spark.createDataFrame([(1, 0, 2, "PORT_SCAN", "a"), (2, 60 * SEC, 2, "BRUTE_FORCE", "a"), (3, 120 * SEC + 1, 2, "DNS_FLOOD", "a")], ALERT)
    found = sorted(X.incidents(a).collect(), key=lambda r: r.first_seen_us)
    assert [(r.alerts, r.severity, r.attack_chain, r.escalated) for r in found] == [(2, 5, "recon_to_exploit", True), (1, 2, None, False)]


def test_token_bucket_burst(spark):
    r = spark.createDataFrame([("k", i, i) for i in range(5)], "k string, ts_us bigint, seq bigint")
    assert [x.allowed for x in X.token_bucket(r, ["k"], 5.0, 3).orderBy("seq").collect()] == [True, True, True, False, False]


@pytest.mark.parametrize("n, pq, trend", [(9, 9, "UNKNOWN"), (10, 10, "IMPROVING"), (19, 0, "STABLE"), (20, 20, "STABLE")])
def test_trend_needs_sessions(spark, n, pq, trend):
    s = spark.createDataFrame([(i, i, "h", i < pq) for i in range(n)], "sess_id bigint, ts_us bigint, host_ip string, has_pq boolean")
    assert W.pq_trend(s).first().trend == trend


def test_interval_ends_are_inclusive(spark):
    rows = spark.createDataFrame([(1, 9), (2, 10), (3, 20), (4, 21), (5, 15)], "id bigint, ts bigint")
    spans = spark.createDataFrame([(10, 20, "a"), (12, 30, "b")], "start_us bigint, end_us bigint, label string")
    for limit in (10, 0):  # the broadcast map and the shuffled join
        got = {r.id: r.label for r in J.label_by_interval(rows, "ts", spans, "id", bucket=7, limit=limit).collect()}
        assert got == {1: "BENIGN", 2: "a", 3: "a", 4: "b", 5: "a"}


def test_geo_without_broadcast(spark):
    rows = spark.createDataFrame([(1, "8.8.8.8"), (2, "10.0.0.1"), (3, "9.9.9.9"), (4, "x")], "id bigint, ip string")
    ranges = spark.createDataFrame([(8 * 2**24, 8 * 2**24 + 2**24 - 1, "US", "C")], "lo bigint, hi bigint, country string, city string")
    for limit in (10**6, 0):
        got = {r.id: (r.country, r.city) for r in J.geo_enriched(rows, "ip", ranges, limit).collect()}
        assert got == {1: ("US", "C"), 2: ("Private", "LAN"), 3: ("Unknown", "Unknown"), 4: ("Private", "LAN")}


def test_level_machine(spark):
    s = spark.createDataFrame([("f", i, i, v) for i, v in enumerate([.4, .4, .4, .8, .1, .1, .1])], "flow_key string, ts_us bigint, row_id bigint, score double")
    got = [r.to_level for r in X.threat_levels(s).orderBy("ts_us").collect()]
    assert got == ["WATCH", "WATCH", "SUSPECT", "HOSTILE", "HOSTILE", "HOSTILE", "BASELINE"]


def test_explanation_names_everything(spark):
    p = spark.createDataFrame([packet(1, 1, ttl=3)], PACKET)
    text = D.alert_explanation(D.detect_all(packets=p, rules=OPEN)).filter(F.col("category") == "TTL_ANOMALY").first().full_explanation
    assert text.startswith("[LOW] TTL_ANOMALY") and "MITRE: T1090.003" in text and "-> watch 10.0.0.1" in text and "-> compare with T1090.003" in text
