"""Queries that run the rule detectors with thresholds lowered to the test traffic."""

from pyspark.sql import functions as F

from packetloom.operators import detectors as D
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.sources import bindings as B

RULES = D.Rules(
    port_scan=3, syn_flood=3, dns_entropy=3.0, dns_label_chars=16, dns_rate=400, brute_force=2, brute_force_s=60.0,
    auth_ports=tuple(range(20, 100)), icmp_rate=12, icmp_entropy=4.2, cidr_whitelist=("10.0.0.0/28",),
    multicast=("192.168.1.3",))
SHAPE = ["seq", "ts_us", "category", "severity", "source_ip", "dest_ip", "dest_port", "confidence"]


def shaped(alerts, factor=0):
    """Core alert columns plus what one evidence factor observed."""
    return alerts.select(*SHAPE, F.col("evidence")[factor]["observed"].alias("observed"))


def _in(width, p="p", q="q", id_="pkt_id"):
    return f"{q}.ts_us > {p}.ts_us - {width} and ({q}.ts_us < {p}.ts_us or ({q}.ts_us = {p}.ts_us and {q}.{id_} <= {p}.{id_}))"


_SYN_BITS = "tcp_flags & 2 > 0 and tcp_flags & 16 = 0"
_SYN = f"protocol = 'TCP' and {_SYN_BITS}"
_NET = "split_part(src_ip, '.', 4)::int < 16"
SCAN = f"""sc as (select pkt_id, ts_us, src_ip, dst_ip, dst_port from packets where protocol = 'TCP' and ({_SYN_BITS} or tcp_flags & 41 > 0 or tcp_flags = 0)),
 sn as (select p.pkt_id, p.ts_us, p.src_ip, p.dst_ip, count(distinct q.dst_port) as n from sc p join sc q on p.src_ip = q.src_ip and {_in(10000000)} group by all)"""
SQL = {
    "port_scan": ("packets", SCAN, f"""select pkt_id as seq, ts_us, 'PORT_SCAN' as category, case when n > 6 then 4 else 3 end as severity, src_ip as source_ip, dst_ip as dest_ip,
 null::int as dest_port, least(1, n / 6) as confidence, n::varchar as observed from sn where n >= 3 and not {_NET}"""),
    "syn_flood": ("packets", f"""sy as (select * from packets where {_SYN}),
 yn as (select p.pkt_id, p.ts_us, p.src_ip, p.dst_ip, count(*) as n from sy p join sy q on p.dst_ip = q.dst_ip and {_in(5000000)} group by all)""",
        """select pkt_id as seq, ts_us, 'SYN_FLOOD' as category, 5 as severity, src_ip as source_ip, dst_ip as dest_ip, null::int as dest_port, least(1, n / 9) as confidence,
 printf('%.1f SYN/sec', n / 5.0e0) as observed from yn where n >= 3"""),
    "brute_force": ("packets", f"""br as (select * from packets where {_SYN} and dst_port between 20 and 99),
 bn as (select p.pkt_id, p.ts_us, p.src_ip, p.dst_ip, p.dst_port, count(*) as n from br p join br q on p.src_ip = q.src_ip and p.dst_port = q.dst_port and {_in(60000000)} group by all)""",
        """select pkt_id as seq, ts_us, 'BRUTE_FORCE' as category, 4 as severity, src_ip as source_ip, dst_ip as dest_ip, dst_port as dest_port, least(1, n / 4) as confidence, n::varchar as observed
 from bn where n >= 2"""),
    "ttl_anomaly": ("packets", "", """select pkt_id as seq, ts_us, 'TTL_ANOMALY' as category, 2 as severity, src_ip as source_ip, dst_ip as dest_ip, null::int as dest_port, 0.3e0 as confidence,
 ttl::varchar as observed from packets where ttl between 1 and 5 and dst_ip <> '192.168.1.3'"""),
    "proto_anomaly": ("packets", "", """select pkt_id as seq, ts_us, 'PROTO_ANOMALY' as category, case when tcp_flags & 1 > 0 then 4 else 3 end as severity, src_ip as source_ip, dst_ip as dest_ip,
 case when tcp_flags & 1 > 0 then dst_port end as dest_port, case when tcp_flags & 1 > 0 then 0.95e0 else 0.85e0 end as confidence, case when tcp_flags & 1 > 0 then 'SYN+FIN' else 'RST+SYN' end as observed
 from packets where protocol = 'TCP' and tcp_flags & 2 > 0 and tcp_flags & 5 > 0"""),
    "dns_tunnel": ("dns", """ql as (select q_id, ts_us, src_ip, unnest(string_split(name, '.')) as label, unnest(range(len(string_split(name, '.')))) as i from dns where not ends_with(lower(name), 'google.com')),
 qd as (select distinct label from ql where length(label) >= 8),
 qc as (select label, unnest(string_split(label, '')) as ch from qd), qn as (select label, ch, count(*) as c from qc group by 1, 2),
 qh as (select label, log2(sum(c)) - sum(c * log2(c)) / sum(c) as h from qn group by 1),
 qf as (select q_id, ts_us, src_ip, arg_min(h, i) as h, arg_min(length(label), i) as n from ql join qh using (label) where h >= 3.0 group by 1, 2, 3)""",
        """select q_id as seq, ts_us, 'DNS_TUNNEL' as category, 4 as severity, src_ip as source_ip, null::varchar as dest_ip, null::int as dest_port, least(1, (h - 3) / 2) as confidence,
 printf('%d chars', n) as observed from qf"""),
    "dns_exfil": ("dns", """el as (select q_id, ts_us, src_ip, list_filter(string_split(name, '.'), lambda x: length(x) >= 16) as l from dns where not ends_with(lower(name), 'google.com'))""",
        """select q_id as seq, ts_us, 'DNS_EXFIL' as category, 3 as severity, src_ip as source_ip, null::varchar as dest_ip, null::int as dest_port, 0.6e0 as confidence,
 printf('%d chars', length(l[1])) as observed from el where len(l) > 0"""),
    "dns_flood": ("dns", """fr as (select q_id, src_ip, ts_us, row_number() over (partition by src_ip order by ts_us, q_id) as rn from dns),
 fg as (select src_ip, ts_us, count(*) over (partition by src_ip order by ts_us range between unbounded preceding and 10000000 preceding) as gone, q_id, rn from fr)""",
        """select q_id as seq, ts_us, 'DNS_FLOOD' as category, 3 as severity, src_ip as source_ip, null::varchar as dest_ip, null::int as dest_port, 0.5e0 as confidence,
 printf('%.1f q/sec', (rn - gone) / 10.0e0) as observed from fg where rn - gone >= 400"""),
    "arp_spoof": ("arp", """av as (select *, lag(sender_mac) over (partition by sender_ip order by ts_us, arp_id) as old from arp where opcode = 2)""",
        """select arp_id as seq, ts_us, 'ARP_SPOOF' as category, 5 as severity, sender_ip as source_ip, null::varchar as dest_ip, null::int as dest_port, 0.9e0 as confidence,
 concat(old, ' -> ', sender_mac) as observed from av where old <> sender_mac"""),
    "icmp_tunnel": ("icmp", """im as (select icmp_id, ts_us, src_ip, dst_ip, octet_length(payload) as n, unnest(string_split(regexp_replace(hex(payload), '(..)', '\\1,', 'g'), ',')) as b from icmp where octet_length(payload) > 64),
 ic as (select icmp_id, ts_us, src_ip, dst_ip, n, b, count(*) as c from im where b <> '' group by all),
 ih as (select icmp_id, ts_us, src_ip, dst_ip, n, log2(sum(c)) - sum(c * log2(c)) / sum(c) as h from ic group by 1, 2, 3, 4, 5)""",
        """select icmp_id as seq, ts_us, 'ICMP_TUNNEL' as category, 4 as severity, src_ip as source_ip, dst_ip as dest_ip, null::int as dest_port, least(1, h / 5) as confidence,
 printf('%d bytes', n) as observed from ih where h > 4.2"""),
    "icmp_flood": ("icmp", f"""xn as (select p.icmp_id, p.ts_us, p.src_ip, p.dst_ip, count(*) as n from icmp p join icmp q on p.src_ip = q.src_ip and {_in(10000000, id_='icmp_id')} group by all)""",
        """select icmp_id as seq, ts_us, 'ICMP_FLOOD' as category, 3 as severity, src_ip as source_ip, dst_ip as dest_ip, null::int as dest_port, 0.5e0 as confidence,
 printf('%.1f pkt/sec', n / 10.0e0) as observed from xn where n >= 12 and icmp_id not in (select icmp_id from ih where h > 4.2)"""),
}
FLOOD_CTES = SQL["icmp_tunnel"][1] + ",\n " + SQL["icmp_flood"][1]


def _sql(name, body=None):
    uses, ctes, final = SQL[name]
    ctes = FLOOD_CTES if name == "icmp_flood" else ctes
    return with_(uses, (ctes + " select_final " + final[7:]) if ctes else final, "confidence")


def _packets_rule(fn):
    return lambda s, d: shaped(fn(B.packets(s, d), RULES))


for _name, _fn in (("port_scan", D.port_scan), ("syn_flood", D.syn_flood), ("brute_force", D.brute_force),
                   ("ttl_anomaly", D.ttl_anomaly), ("proto_anomaly", D.proto_anomaly)):
    query(f"detect_{_name}", _sql(_name))(_packets_rule(_fn))
for _name, _fn, _i in (("dns_tunnel", D.dns_tunnel, 1), ("dns_exfil", D.dns_exfil, 0), ("dns_flood", D.dns_flood, 0)):
    query(f"detect_{_name}", _sql(_name))(lambda s, d, f=_fn, i=_i: shaped(f(B.dns_queries(s, d), RULES), i))
query("detect_arp_spoof", _sql("arp_spoof"))(lambda s, d: shaped(D.arp_spoof(B.arp(s, d), RULES)))
for _name, _fn in (("icmp_tunnel", D.icmp_tunnel), ("icmp_flood", D.icmp_flood)):
    query(f"detect_{_name}", _sql(_name))(lambda s, d, f=_fn: shaped(f(B.icmp(s, d), RULES)))


def all_alerts(spark, d):
    return D.detect_all(B.packets(spark, d), B.dns_queries(spark, d), B.arp(spark, d), B.icmp(spark, d), "medium", RULES)


_ALL_CTES = ",\n ".join([c for n, (_, c, _) in SQL.items() if c])
_ALL_UNION = " union all ".join(f"({f})" for _, _, f in SQL.values())
ALL_SQL = f"{_ALL_CTES}, al as ({_ALL_UNION})"


@query("detect_all", with_("packets dns arp icmp", ALL_SQL + " select_final category, severity, count(*) as alerts, avg(confidence) as confidence, count(distinct source_ip) as sources from al group by 1, 2", "confidence"))
def detect_all(spark, d):
    return all_alerts(spark, d).groupBy("category", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.avg("confidence").alias("confidence"), F.count_distinct("source_ip").alias("sources"))


@query("detect_whitelist_suppressed", with_("packets dns", SCAN + f""" select_final 'cidr' as whitelist, count(*) as suppressed from sn where n >= 3 and {_NET}
 union all select 'multicast', count(*) from packets where ttl between 1 and 5 and dst_ip = '192.168.1.3' union all select 'domain', count(*) from dns where ends_with(lower(name), 'google.com')"""))
def suppressed(spark, d):
    return D.whitelist_suppressed(B.packets(spark, d), B.dns_queries(spark, d), RULES)


@query("detect_ids_stats", with_("packets dns arp", SCAN + f""", al as ({SQL['ttl_anomaly'][2]} union all {SQL['proto_anomaly'][2]})
 select_final (select count(*) from packets) as packets_analyzed, (select count(distinct src_ip) from packets where protocol = 'TCP' and (tcp_flags = 0 or tcp_flags & 41 > 0 or (tcp_flags & 2 > 0 and tcp_flags & 16 = 0))) as tracked_sources,
 count(*) as threats_detected, count(*) filter (severity = 1) as info, count(*) filter (severity = 2) as low, count(*) filter (severity = 3) as medium, count(*) filter (severity = 4) as high, count(*) filter (severity = 5) as critical,
 (select count(*) from sn where n >= 3 and {_NET})::bigint + (select count(*) from packets where ttl between 1 and 5 and dst_ip = '192.168.1.3') + (select count(*) from dns where ends_with(lower(name), 'google.com')) as whitelist_suppressed,
 (select count(distinct sender_ip) from arp where opcode = 2) as arp_table_size from al"""))
def stats(spark, d):
    p = B.packets(spark, d)
    found = D.ttl_anomaly(p, RULES).unionByName(D.proto_anomaly(p, RULES))
    return D.ids_stats(p, found, D.whitelist_suppressed(p, B.dns_queries(spark, d), RULES), B.arp(spark, d))


@query("detect_scan_methods", with_("packets", f"""k as (select pkt_id, src_ip, ts_us, case when tcp_flags & 2 > 0 and tcp_flags & 16 = 0 then 'SYN' when tcp_flags = 1 then 'FIN' when tcp_flags & 41 > 0 then 'XMAS' when tcp_flags = 0 then 'NULL' end as t from packets where protocol = 'TCP')
 select_final pkt_id, t as scan_type, list_aggregate(list_sort(list_distinct(list(t) over (partition by src_ip order by ts_us, pkt_id))), 'string_agg', '/') as methods from k where t is not null"""))
def methods(spark, d):
    return D.scan_probes(B.packets(spark, d), RULES).select("pkt_id", "scan_type", "methods")


@query("detect_syn_ack_balance", with_("packets", """s as (select pkt_id, ts_us, case when tcp_flags & 16 > 0 then src_ip else dst_ip end as host, tcp_flags & 16 > 0 as ack from packets where protocol = 'TCP' and tcp_flags & 2 > 0),
 r as (select *, count(*) filter (ack) over (partition by host order by ts_us, pkt_id) as acks from s)
 select_final pkt_id as seq, acks::varchar as syn_acks from r where not ack"""))
def balance(spark, d):
    rules = D.replace(RULES, syn_flood=1)
    return D.syn_flood(B.packets(spark, d), rules).select("seq", F.col("evidence")[2]["observed"].alias("syn_acks"))


@query("fn_alert_explanation", with_("packets", """select pkt_id as seq, printf('[LOW] TTL_ANOMALY: Low TTL=%d from %s to %s', ttl, src_ip, dst_ip) as headline, 11 as lines from packets where ttl between 1 and 5 and dst_ip <> '192.168.1.3'"""))
def explanation(spark, d):
    text = D.alert_explanation(D.with_category_dims(D.ttl_anomaly(B.packets(spark, d), RULES)))
    lines = F.split("full_explanation", "\n")
    return text.select("seq", lines[0].alias("headline"), (F.size(lines) + 2).alias("lines"))
