"""Source, sink, decoding and scalar-function queries."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from packetloom.functions import names as N
from packetloom.functions import scalars as S
from packetloom.functions import tls as T
from packetloom.operators import aggregates as A
from packetloom.operators import detectors as D
from packetloom.operators import models as M
from packetloom.operators.joins import with_category_dims
from packetloom.operators.ordered import OrderedGroups
from packetloom.plans.detection import RULES
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.plans.state import connections
from packetloom.session import durable_dir
from packetloom.sources import bindings as B
from packetloom.sources import flows_csv as C
from packetloom.sources import frames as L
from packetloom.sources import packets as P
from packetloom.sources import sinks as K


def scratch(spark):
    """A fresh path for files that a query writes and reads back."""
    return f"{durable_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


# ---- frames ---------------------------------------------------------------------------------------

_KIND = "case event_type when 'view' then 'http' when 'click' then case when k % 2 = 0 then 'ssh' else 'tls' end when 'purchase' then 'dns' when 'signup' then 'icmp' else case when k % 2 = 0 then 'short' else 'arp' end end"
_FR = f"fr as (select *, {_KIND} as w, concat('10.0.0.', user_id % 250) as uip, concat('192.168.1.', k % 16) as pip from ev)"


def decoded(spark, d, trim=True):
    return L.decode_l2_l4(B.frames(spark, d), trim)


# frames cut short keep a readable Ethernet header unless their VLAN tag is cut
@query("src_decode_l2_l4", with_("ev", _FR + """, f2 as (select *, case when w = 'short' and k % 10 = 0 then false else true end as eth, w in ('http','ssh','tls','dns','icmp') as ip, w in ('http','ssh','tls') as tcp from fr)
 select_final event_id as frame_id, case when w <> 'short' and k % 10 = 0 then k end as vlan_id, case when w = 'short' then null when w = 'arp' then 2054 else 2048 end as ether_type,
 case when ip then uip end as src_ip, case when ip then pip end as dst_ip, case when ip then 1 + k % 64 end as ttl, case when tcp then 6 when w = 'dns' then 17 when w = 'icmp' then 1 end as ip_proto,
 case when ip then (event_id % 65536)::int end as identification, case when ip then true end as dont_fragment,
 case when tcp or w = 'dns' then (40000 + event_id % 64)::int end as src_port, case w when 'http' then 80 when 'ssh' then 22 when 'tls' then 443 when 'dns' then 53 end as dst_port,
 case when tcp then event_id end as seq_num, case when tcp then user_id end as ack_num, case when tcp then ((event_id * 7 + k) % 64)::int end as tcp_flags,
 case when w = 'icmp' then 8 end as icmp_type, case when w = 'icmp' then k end as icmp_id, case when w = 'arp' then 2 end as arp_opcode, case when w = 'arp' then uip end as arp_sender_ip,
 case w when 'http' then length(concat('GET /p/', event_id, ' HTTP/1.1..Host: h', user_id, '.example.com..User-Agent: ua/', k, '..Content-Length: ', k, '....')) when 'ssh' then length(concat('SSH-2.0-OpenSSH_', k, '..')) when 'icmp' then length(concat('ping', event_id)) end as payload_bytes from f2"""))
def l2_l4(spark, d):
    plain = F.when(F.col("ip_proto") == 1, 1).when(F.col("dst_port").isin(80, 22), 1)
    return decoded(spark, d).select(
        "frame_id", "vlan_id", F.when(F.col("frame_size") > 14, F.col("ether_type")).alias("ether_type"), "src_ip", "dst_ip", "ttl", "ip_proto", "identification",
        "dont_fragment", "src_port", "dst_port", "seq_num", "ack_num", "tcp_flags", "icmp_type", "icmp_id", "arp_opcode", "arp_sender_ip",
        F.when(plain == 1, F.octet_length("payload")).alias("payload_bytes"))


query("src_split_malformed", with_("ev", _FR + " select_final count(*) filter (w <> 'short') as parsed, count(*) filter (w = 'short') as malformed from fr"))(
    lambda s, d: L.parse_counts(decoded(s, d)))
query("src_dead_letters", with_("ev", _FR + " select_final event_id as frame_id from fr where w = 'short'"))(lambda s, d: L.split_malformed(decoded(s, d))[1].select("frame_id"))
query("src_classify_protocol", with_("ev", _FR + " select_final case w when 'short' then 'UNKNOWN' else upper(w) end as protocol, count(*) as frames from fr group by 1"))(
    lambda s, d: L.classify_protocol(decoded(s, d)).groupBy("protocol").agg(F.count(F.lit(1)).alias("frames")))


@query("src_http_fields", with_("ev", _FR + """ select_final event_id as frame_id, true as is_request, 'GET' as method, concat('/p/', event_id) as uri, 'HTTP/1.1' as version, concat('h', user_id, '.example.com') as host,
 concat('ua/', k) as user_agent, k::bigint as content_length, 3 as headers from fr where w = 'http'"""))
def http(spark, d):
    f = L.http_fields(L.classify_protocol(decoded(spark, d)).filter("protocol = 'HTTP'"))
    return f.select("frame_id", "is_request", "method", "uri", "version", "host", "user_agent", "content_length", F.size("headers").alias("headers"))


query("src_ssh_banner", with_("ev", _FR + " select_final event_id as frame_id, '2.0' as ssh_protocol, concat('OpenSSH_', k) as ssh_software from fr where w = 'ssh'"))(
    lambda s, d: L.classify_protocol(decoded(s, d)).filter("protocol = 'SSH'").select("frame_id", *[c.alias(n) for n, c in L.ssh_banner(F.col("payload")).items()]))


def l7(spark, d):
    return L.decode_l7(L.classify_protocol(decoded(spark, d)))


@query("src_decode_dns", with_("ev", _FR + """ select_final event_id as frame_id, (event_id % 65536)::int as txid, true as is_response, concat('q', event_id, '.example.com') as question, 'A' as qtype, concat('q', event_id, '.example.com') as answer_name,
 60::bigint as ttl, concat('10.0.0.', user_id % 250) as rdata from fr where w = 'dns'"""))
def dns(spark, d):
    q, a = F.get("dns.questions", F.lit(0)), F.get("dns.answers", F.lit(0))
    return l7(spark, d).filter("dns is not null").select("frame_id", "dns.txid", "dns.is_response", q["name"].alias("question"), N.dns_type_name(q["qtype"]).alias("qtype"),
                                                         a["name"].alias("answer_name"), a["ttl"].alias("ttl"), a["rdata"].alias("rdata"))


_SUITE = f"([{', '.join(map(str, B.SUITE_IDS))}])[1 + k % {len(B.SUITE_IDS)}]"


@query("src_decode_tls", with_("ev", _FR + f""", t as (select *, {_SUITE} as suite, case when k % 3 = 0 then 25497 else 29 end as grp from fr where w = 'tls')
 select_final event_id as frame_id, concat('s', user_id, '.example.com') as sni, 'TLS 1.3' as version, k % 3 = 0 as pq, md5(concat('771,', suite, '-4865,0-10-11-43,29-', grp, ',0')) as ja3 from t"""))
def tls(spark, d):
    t = {c: F.col(f"tls.{c}") for c in L._TLS}
    version = N.tls_version_name(T.hello_version(t["tls_version"], t["supported_versions"]))
    ja3 = T.ja3(t["tls_version"], t["cipher_suites"], t["extension_ids"], t["supported_groups"], t["ec_point_formats"])
    return l7(spark, d).filter("tls is not null").select("frame_id", t["sni"].alias("sni"), version.alias("version"),
                                                         T.has_post_quantum(t["supported_groups"]).alias("pq"), ja3.alias("ja3"))


# ---- scalar functions -------------------------------------------------------------------------------

def hellos(spark, d):
    k = F.col("k")
    arr = F.array
    return B.events(spark, d).select(
        F.col("event_id").alias("sess_id"), (769 + k % 4).alias("tls_version"), arr(F.lit(0x0A0A), (4865 + k % 3).cast("int"), (49171 + k % 20).cast("int")).alias("suites"),
        arr((43 + k % 5).cast("int"), F.lit(0), F.lit(0x1A1A), F.lit(10)).alias("ext"), arr(F.lit(29), F.when(k % 7 == 0, 0x6399).otherwise(23)).alias("groups"),
        arr(F.lit(0)).alias("points"), F.when(k % 2 == 0, arr((770 + k % 3).cast("int"), F.lit(771))).otherwise(F.array().cast("array<int>")).alias("versions"))


@query("fn_ja3", with_("ev", """select event_id as sess_id, md5(concat(769 + k % 4, ',', 4865 + k % 3, '-', 49171 + k % 20, ',', '0-10-', 43 + k % 5, ',29-', case when k % 7 = 0 then 25497 else 23 end, ',0')) as ja3 from ev"""))
def ja3(spark, d):
    return hellos(spark, d).select("sess_id", T.ja3(*[F.col(c) for c in ("tls_version", "suites", "ext", "groups", "points")]).alias("ja3"))


@query("fn_hello_version_pq", with_("ev", """v as (select event_id as sess_id, k % 7 = 0 as pq, case when k % 2 = 0 then greatest(770 + k % 3, 771) else 769 + k % 4 end as v from ev)
 select_final sess_id, pq, case v when 769 then 'TLS 1.0' when 770 then 'TLS 1.1' when 771 then 'TLS 1.2' else 'TLS 1.3' end as version from v"""))
def hello_version(spark, d):
    v = T.hello_version(F.col("tls_version"), F.col("versions"))
    return hellos(spark, d).select("sess_id", T.has_post_quantum(F.col("groups")).alias("pq"), N.tls_version_name(v).alias("version"))


@query("fn_tls_grade", with_("tls", """a as (select sess_id, cipher_suite as c, tls_version as v, has_pq, cipher_suite between 4865 and 4868 or tls_version = 772 as modern,
  cipher_suite in (47,53,60,61,156,157) as rsa, cipher_suite in (49171,49172,49191,49192,49199,49200,49161,49162,49187,49188,49195,49196,52392,52393,51,57,158) as eph,
  cipher_suite in (4865,4866,4867,4868,156,157,158,49199,49200,49195,49196,52392,52393) as strong, cipher_suite in (47,53,60,61,51,57,49171,49172,49161,49162,49191,49192,49187,49188) as moderate from tls),
 b as (select *, modern or eph as fs, case when v = 772 then 3 else 2 end + case when strong then 3 when moderate then 2 else 0 end + case when modern or eph then 2 else 0 end + case when has_pq then 2 else 0 end as p from a)
 select_final sess_id, fs as forward_secrecy, case when v = 772 then 'TLS 1.3' else 'TLS 1.2' end as version_name, case when strong then 'STRONG' when moderate then 'MODERATE' else 'UNKNOWN' end as cipher_strength,
 case when has_pq then 'SAFE' when rsa and not modern then 'CRITICAL' else 'AT_RISK' end as verdict, case when p >= 10 then 'A+' when p >= 8 then 'A' when p >= 6 then 'B' when p >= 4 then 'C' when p >= 2 then 'D' else 'F' end as grade,
 (v <> 772)::int + (not strong)::int + (not fs)::int + (not has_pq)::int as advice from b"""))
def grade(spark, d):
    groups = F.when(F.col("has_pq"), F.array(F.lit(0x639A))).otherwise(F.array(F.lit(29)))
    g = T.tls_grade(F.col("cipher_suite"), F.col("tls_version"), groups)
    return B.tls_sessions(spark, d).select("sess_id", *[g[c].alias(c) for c in ("forward_secrecy", "version_name", "cipher_strength", "verdict", "grade")],
                                           F.size(g["recommendations"]).alias("advice"))


@query("fn_entropy_text", with_("", """u as (select page_id, unnest(string_split(url, '')) as ch from pages), c as (select page_id, ch, count(*) as n from u group by 1, 2)
 select_final page_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from c group by 1""", "entropy"))
def entropy_text(spark, d):
    return B.page_hosts(spark, d).select("page_id", S.entropy_text(F.col("url")).alias("entropy"))


@query("fn_entropy_bytes", with_("icmp", """u as (select icmp_id, unnest(string_split(regexp_replace(hex(payload), '(..)', '\\1,', 'g'), ',')) as b from icmp), c as (select icmp_id, b, count(*) as n from u where b <> '' group by 1, 2)
 select_final icmp_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from c group by 1""", "entropy"))
def entropy_bytes(spark, d):
    return B.icmp(spark, d).select("icmp_id", S.entropy_bytes(F.col("payload")).alias("entropy"))


query("fn_format_bytes", with_("packets", """v as (select pkt_id, size * case when pkt_id % 2 = 0 then 64 else (10 ** (pkt_id % 14))::bigint end + pkt_id % 2 as n from packets)
 select_final pkt_id, case when n < 1024 then printf('%.1f B', n::double) when n < 1024^2 then printf('%.1f KB', n / 1024.0e0) when n < 1024^3 then printf('%.1f MB', n / 1024.0e0^2) when n < 1024^4 then printf('%.1f GB', n / 1024.0e0^3)
  when n < 1024^5 then printf('%.1f TB', n / 1024.0e0^4) else printf('%.1f PB', n / 1024.0e0^5) end as text from v"""))(
    lambda s, d: B.packets(s, d).select("pkt_id", (F.col("size") * F.when(F.col("pkt_id") % 2 == 0, F.lit(64).cast("bigint")).otherwise(F.pow(F.lit(10), F.col("pkt_id") % 14).cast("bigint")) + F.col("pkt_id") % 2).alias("n"))
    .select("pkt_id", S.format_bytes(F.col("n")).alias("text")))
query("fn_sigmoid_joint", with_("scores", "select row_id, 1 / (1 + exp(-(score * 20 - 5))) as s, 1 - (1 - score) * (1 - score / 2) as j from scores", "s j"))(
    lambda s, d: B.scores(s, d).select("row_id", S.sigmoid(F.col("score") * 20 - 5).alias("s"), S.joint_confidence(F.col("score"), F.col("score") / 2).alias("j")))
query("fn_score_severity", with_("scores", """select row_id, case when score >= 0.75 then 5 when score >= 0.65 then 4 when score >= 0.55 then 3 else 2 end as severity,
 case when score * 10 - 5 >= 5 or score * 10 - 5 <= -5 then 5 when abs(score * 10 - 5) >= 4 then 4 when abs(score * 10 - 5) >= 3 then 3 else 2 end as z_severity from scores"""))(
    lambda s, d: B.scores(s, d).select("row_id", S.score_severity(F.col("score")).alias("severity"), S.z_severity(F.col("score") * 10 - 5).alias("z_severity")))
query("fn_severity_names", with_("alerts", """select distinct severity, (['INFO','LOW','MEDIUM','HIGH','CRITICAL'])[severity] as label, (['i','!','!!','!!!','!!!!'])[severity] as icon, ([10,25,50,75,95])[severity] as confidence from alerts"""))(
    lambda s, d: B.alerts(s, d).select("severity").distinct().select("severity", N.severity_label(F.col("severity")).alias("label"),
                                                                   N.severity_icon(F.col("severity")).alias("icon"), N.stix_confidence(F.col("severity")).alias("confidence")))
_H = "sha256(concat('ipv4-addr-seed|', src_ip))[1:16]"
query("fn_stix_id", with_("packets", f"""h as (select distinct src_ip, {_H} as h from packets)
 select_final src_ip, concat('ipv4-addr--', h[1:8], '-', h[9:12], '-4', h[13:15], '-', h[1:1], h[16:16], '-', '00') as id from h"""))(
    lambda s, d: B.packets(s, d).select("src_ip").distinct().select("src_ip", S.stix_id("ipv4-addr", F.lit("ipv4-addr-seed"), F.col("src_ip")).alias("id")))
query("fn_stix_timestamp_pattern", with_("alerts", """select alert_id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') as at, case category when 'PORT_SCAN' then concat('[network-traffic:src_ref.type = ''ipv4-addr'' AND network-traffic:src_ref.value = ''', source_ip, ''']')
 when 'SYN_FLOOD' then concat('[network-traffic:dst_ref.type = ''ipv4-addr'' AND network-traffic:dst_ref.value = ''', dest_ip, ''']') when 'DNS_TUNNEL' then concat('[domain-name:value LIKE ''%'' AND network-traffic:src_ref.value = ''', source_ip, ''']')
 when 'DNS_EXFIL' then concat('[domain-name:value LIKE ''%'' AND network-traffic:src_ref.value = ''', source_ip, ''']') when 'ARP_SPOOF' then concat('[mac-addr:value = ''', description, ''']')
 when 'BRUTE_FORCE' then concat('[network-traffic:dst_port = ', dest_port, ' AND network-traffic:src_ref.value = ''', source_ip, ''']') when 'ICMP_TUNNEL' then concat('[network-traffic:protocols[0] = ''icmp'' AND network-traffic:src_ref.value = ''', source_ip, ''']')
 else concat('[network-traffic:src_ref.value = ''', source_ip, ''']') end as pattern from alerts"""))(
    lambda s, d: B.alerts(s, d).select("alert_id", S.stix_timestamp(F.col("ts_us")).alias("at"), S.stix_pattern(
        *[F.col(c) for c in ("category", "source_ip", "dest_ip", "dest_port", "description")]).alias("pattern")))
query("fn_quantum_risk", with_("tls", """select sess_id, case when cipher_suite in (47,53,60,61,156,157) then 'CRITICAL' when cipher_suite in (4865,4866,4867) then 'SAFE' else 'AT_RISK' end as risk from tls"""))(
    lambda s, d: B.tls_sessions(s, d).join(F.broadcast(T.risk_dimension(s)), F.col("cipher_suite") == F.col("suite_id"), "left")
    .select("sess_id", T.quantum_risk(F.col("kex"), F.col("vulnerable"))["risk"].alias("risk")))
query("fn_dns_labels", with_("", """h as (select page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) as host from pages) select_final page_id, string_split(host, '.') as labels, len(string_split(host, '.'))::int as n from h"""))(
    lambda s, d: B.page_hosts(s, d).select("page_id", S.dns_labels(F.col("host")).alias("labels"), F.size(S.dns_labels(F.col("host"))).alias("n")))
query("fn_name_lookups", with_("packets", """select pkt_id, case dst_port when 21 then 'FTP' when 22 then 'SSH' when 23 then 'Telnet' else dst_port::varchar end as service,
 case ttl when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP' when 58 then 'ICMPv6' else ttl::varchar end as proto,
 case ttl when 0 then 'Echo Reply' when 3 then 'Dest Unreachable' when 4 then 'Source Quench' when 5 then 'Redirect' when 8 then 'Echo Request' when 11 then 'Time Exceeded' when 13 then 'Timestamp' when 14 then 'Timestamp Reply' when 30 then 'Traceroute' else concat('Type_', ttl) end as icmp,
 case ttl when 1 then 'REQUEST' when 2 then 'REPLY' else ttl::varchar end as arp, case when ttl between 1 and 8 then (['DISCOVER','OFFER','REQUEST','DECLINE','ACK','NAK','RELEASE','INFORM'])[ttl] else ttl::varchar end as dhcp,
 concat('0x', lpad(upper(to_hex(dst_port)), 4, '0')) as ether, case when ttl = 1 then 'QUIC v1 (RFC 9000)' else concat('0x', lpad(upper(to_hex(ttl)), 8, '0')) end as quic,
 case ttl when 0 then 'NOERROR' when 1 then 'FORMERR' when 2 then 'SERVFAIL' when 3 then 'NXDOMAIN' when 4 then 'NOTIMP' when 5 then 'REFUSED' else concat('RCODE', ttl) end as rcode from packets"""))(
    lambda s, d: B.packets(s, d).select(
        "pkt_id", N.service_name(F.col("dst_port")).alias("service"), *[f(F.col("ttl")).alias(n) for n, f in (
            ("proto", N.ip_protocol_name), ("icmp", N.icmp_type_name), ("arp", N.arp_op_name), ("dhcp", N.dhcp_message_name),
            ("quic", N.quic_version_name), ("rcode", N.dns_rcode_name))], N.ether_type_name(F.col("dst_port")).alias("ether")))
_BITS = ", ".join(f"case when tcp_flags & {b} > 0 then '{n}' end" for n, b in N.FLAG_BITS.items())
query("fn_flag_predicates", with_("packets", f"""select pkt_id, tcp_flags & 2 > 0 and tcp_flags & 16 = 0 as syn, tcp_flags & 18 = 18 as syn_ack, tcp_flags & 41 > 0 as xmas, tcp_flags & 41 = 41 as xmas_strict, tcp_flags = 0 as is_null,
 coalesce(nullif(concat_ws('|', {_BITS}), ''), 'NONE') as names, case when tcp_flags & 2 > 0 and tcp_flags & 16 = 0 then 'SYN' when tcp_flags = 1 then 'FIN' when tcp_flags & 41 > 0 then 'XMAS' when tcp_flags = 0 then 'NULL' end as scan from packets"""))(
    lambda s, d: B.packets(s, d).select("pkt_id", *[c.alias(n) for n, c in (
        ("syn", S.is_syn(F.col("tcp_flags"))), ("syn_ack", S.is_syn_ack(F.col("tcp_flags"))), ("xmas", S.is_xmas(F.col("tcp_flags"))),
        ("xmas_strict", S.is_xmas(F.col("tcp_flags"), True)), ("is_null", F.col("tcp_flags") == 0), ("names", N.flag_names(F.col("tcp_flags"))),
        ("scan", S.scan_type(F.col("tcp_flags"))))]))
query("fn_canonical_flow_key", with_("conv", """select pkt_id, case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip else dst_ip end as ip_low, case when (src_ip, src_port) <= (dst_ip, dst_port) then src_port else dst_port end as port_low,
 case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_ip else src_ip end as ip_high, case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_port else src_port end as port_high from conv"""))(
    lambda s, d: B.conversations_packets(s, d).select("pkt_id", *[c.alias(n) for n, c in S.conversation().items()]))
query("fn_private_ip", with_("packets", """p as (select pkt_id, case pkt_id % 4 when 0 then src_ip when 1 then dst_ip when 2 then replace(src_ip, '10.0', '172.' || (pkt_id % 40)) else 'host-' || pkt_id end as ip from packets)
 select_final pkt_id, ip, ip like '10.%' or ip like '192.168.%' or ip like 'host%' or (ip like '172.%' and try_cast(split_part(ip, '.', 2) as int) between 16 and 31) as private from p"""))(
    lambda s, d: B.packets(s, d).select("pkt_id", F.when(F.col("pkt_id") % 4 == 0, F.col("src_ip")).when(F.col("pkt_id") % 4 == 1, F.col("dst_ip"))
                                        .when(F.col("pkt_id") % 4 == 2, F.replace("src_ip", F.lit("10.0"), F.concat(F.lit("172."), (F.col("pkt_id") % 40).cast("string"))))
                                        .otherwise(F.concat(F.lit("host-"), F.col("pkt_id").cast("string"))).alias("ip"))
    .withColumn("private", S.is_private_ip(F.col("ip"))))
query("fn_domain_whitelist", with_("dns", """select q_id, ends_with(lower(name), 'google.com') or ends_with(lower(name), 'ple.net') as listed, ends_with(lower(name), '.google.com') as bounded from dns"""))(
    lambda s, d: B.dns_queries(s, d).select("q_id", S.domain_listed(F.col("name"), ["google.com", "ple.net"]).alias("listed"),
                                            S.domain_listed(F.col("name"), ["google.com", "ple.net"], dot_boundary=True).alias("bounded")))


@query("fn_is_forward", with_("conv", """select pkt_id, src_ip = first_value(src_ip) over w and src_port = first_value(src_port) over w as is_forward from conv
 window w as (partition by least(src_ip, dst_ip), greatest(src_ip, dst_ip), greatest(src_port, dst_port), protocol order by ts_us, pkt_id)"""))
def is_forward(spark, d):
    p = B.conversations_packets(spark, d).withColumns(S.conversation())
    keys = ["ip_low", "port_low", "ip_high", "port_high", "protocol"]
    first = p.groupBy(*keys).agg(F.min_by(F.struct("src_ip", "src_port"), F.struct("ts_us", "pkt_id")).alias("_first"))
    same = (F.col("src_ip") == F.col("_first.src_ip")) & (F.col("src_port") == F.col("_first.src_port"))
    return p.join(first, keys).select("pkt_id", same.alias("is_forward"))


@query("fn_normalize_label", with_("scores", """l as (select row_id, (['BENIGN', ' Bot', 'DoS Hulk', 'SSH-Patator ', 'PortScan', 'Web Attack – XSS', 'Heartbleed', 'Other'])[1 + row_id % 8] as raw from scores),
 m as (select row_id, raw, case trim(raw) when 'Bot' then 'Botnet' when 'DoS Hulk' then 'DoS' when 'SSH-Patator' then 'BruteForce' when 'Web Attack – XSS' then 'WebAttack' else trim(raw) end as family from l)
 select_final row_id, family, case family when 'BENIGN' then 'Benign' when 'Botnet' then 'Bot' when 'BruteForce' then 'Brute Force' when 'PortScan' then 'Port Scan' when 'WebAttack' then 'Web Attack' else family end as spaced, case when trim(raw) = 'BENIGN' then 0 else 1 end as y from m"""))
def labels(spark, d):
    raw = F.array(*[F.lit(x) for x in ("BENIGN", " Bot", "DoS Hulk", "SSH-Patator ", "PortScan", "Web Attack – XSS", "Heartbleed", "Other")])
    r = F.element_at(raw, (1 + F.col("row_id") % 8).cast("int"))
    return B.scores(spark, d).select("row_id", S.attack_family(r).alias("family"), S.attack_family(r, spaced=True).alias("spaced"), S.is_attack(r).alias("y"))


@query("fn_sensitivity_profile", with_("packets", """s as (select pkt_id, tcp_flags & 2 > 0 and tcp_flags & 16 = 0 and protocol = 'TCP' as syn from packets), l as (select unnest(['low','medium','high']) as level, unnest([25,15,8]) as port_scan, unnest([200,100,50]) as syn_flood, unnest([4.0e0,3.8e0,3.5e0]) as dns_entropy, unnest([20,10,5]) as brute_force)
 select_final l.*, (select count(*) from s where syn) >= syn_flood as total_over from l""", "dns_entropy"))
def profiles(spark, d):
    syns = B.packets(spark, d).filter((F.col("protocol") == "TCP") & S.is_syn(F.col("tcp_flags"))).agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for level in D.LEVELS:
        r = D.sensitivity_profile(level)
        rows.append(F.struct(F.lit(level).alias("level"), F.lit(r.port_scan).alias("port_scan"), F.lit(r.syn_flood).alias("syn_flood"),
                             F.lit(float(r.dns_entropy)).alias("dns_entropy"), F.lit(r.brute_force).alias("brute_force"), (F.col("n") >= r.syn_flood).alias("total_over")))
    return syns.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


query("fn_alerts_min_severity", with_("alerts", "select alert_id, severity from alerts where severity >= 4"))(lambda s, d: B.alerts(s, d).filter("severity >= 4").select("alert_id", "severity"))
query("fn_min_packets", with_("conv", "select src_ip, dst_ip, dst_port, count(*) as n from conv group by 1, 2, 3 having count(*) >= 5"))(
    lambda s, d: A.flow_features_8(B.conversations_packets(s, d), min_packets=5).select("src_ip", "dst_ip", "dst_port", F.col("packet_count").alias("n")))


# ---- files ------------------------------------------------------------------------------------------

@query("src_read_packets", with_("packets", "select pkt_id, ts_us, src_ip, dst_port, size from packets"))
def read_packets(spark, d):
    path = scratch(spark)
    B.packets(spark, d).write.json(path)
    return P.read_packets(spark, path, "json").select("pkt_id", "ts_us", "src_ip", "dst_port", "size")


query("src_read_packets_parquet", with_("packets", "select node_id, count(*) as n from packets group by 1"))(
    lambda s, d: _through(s, B.packets(s, d), "parquet").groupBy("node_id").agg(F.count(F.lit(1)).alias("n")))


def _through(spark, df, fmt):
    path = scratch(spark)
    df.write.format(fmt).option("header", True).save(path)
    return P.read_packets(spark, path, fmt)


query("src_read_packets_orc", with_("packets", "select protocol, sum(size)::bigint as bytes from packets group by 1"))(
    lambda s, d: _through(s, B.packets(s, d), "orc").groupBy("protocol").agg(F.sum("size").alias("bytes")))
query("src_read_packets_csv", with_("packets", "select protocol, max(ttl) as ttl from packets group by 1"))(
    lambda s, d: _through(s, B.packets(s, d).select(*P.PACKETS.fieldNames()), "csv").groupBy("protocol").agg(F.max("ttl").alias("ttl")))


@query("src_sensor_messages", with_("packets", "select node_id, pkt_id from packets"))
def messages(spark, d):
    """Odd packets arrive singly, even ones in per-second batches."""
    p = B.packets(spark, d)
    row = F.struct(*P.PACKETS.fieldNames())
    single = p.filter("pkt_id % 2 = 1").select("node_id", row.alias("packet"))
    batch = p.filter("pkt_id % 2 = 0").groupBy("node_id", F.floor(F.col("ts_us") / 1000000).alias("s")).agg(F.collect_list(row).alias("packets")).drop("s")
    return P.from_messages(single.unionByName(batch, allowMissingColumns=True)).select("node_id", "pkt_id")


HEADER = "Src IP, Dst IP,Src Port, Dst Port ,Protocol, Flow Duration, Total Fwd Packets, Flow Packets/s,Average Packet Size, SYN Flag Count,Destination Port, row_id, Label"


def write_flow_csv(spark, d):
    """Flow CSV files derived from the events: ragged rows, infinities, NaN and junk included."""
    k, eid = F.col("k"), F.col("event_id")
    rate = F.when(k % 10 == 0, "Infinity").when(k % 10 == 1, "NaN").when(k % 10 == 2, "n/a").otherwise(F.col("value").cast("string"))
    label = F.when(k % 4 == 0, "DoS Hulk").when(k % 4 == 1, " PortScan").otherwise("BENIGN")
    fields = [F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), F.lit("192.168.1.1"), (40000 + eid % 64).cast("string"), (20 + k).cast("string"), F.lit("6"),
              (k * 1000).cast("string"), (k % 9).cast("string"), rate, (k * 2).cast("string"), (k % 3).cast("string"), (20 + k).cast("string"), eid.cast("string"), label]
    line = F.concat_ws(",", *fields, F.when(eid % 50 == 7, "extra"))
    line = F.when(eid % 50 == 8, F.substring_index(line, ",", 5)).otherwise(line)

    def with_header(batches):
        yield pd.DataFrame({"value": [HEADER]})
        yield from batches

    path = scratch(spark)
    B.events(spark, d).select(line.alias("value")).mapInPandas(with_header, "value string").write.text(path)
    return path


_CSV = "cs as (select *, case when k % 4 = 0 then 'DoS' when k % 4 = 1 then 'PortScan' else 'BENIGN' end as label from ev where event_id % 50 not in (7, 8))"


@query("src_read_flow_csv", with_("ev", _CSV + """ select_final event_id::double as row_id, k * 1000.0e0 as flow_duration, case when k % 10 < 3 then 0 else value end as rate, 0.0e0 as src_ip, label, case when label = 'BENIGN' then 0 else 1 end as y from cs""", "rate"))
def flow_csv(spark, d):
    f = C.read_flow_csv(spark, write_flow_csv(spark, d))
    return f.select("row_id", F.col("Flow Duration").alias("flow_duration"), F.col("`Flow Packets/s`").alias("rate"), F.col("`Src IP`").alias("src_ip"), "label", "y")


@query("src_read_flow_dir", with_("ev", _CSV + " select_final label, y, 2 * count(*) as n from (select label, case when label = 'BENIGN' then 0 else 1 end as y from cs) group by 1, 2"))
def flow_dir(spark, d):
    f = C.read_flow_dir(spark, [write_flow_csv(spark, d), write_flow_csv(spark, d)])
    return f.groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))


query("src_read_flow_dir_sampled")(lambda s, d: C.read_flow_dir(s, [write_flow_csv(s, d)], keep_benign=0.5).groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("src_map_columns_14", with_("ev", _CSV + """ select_final count(*) as n, sum(k * 1000)::double as flow_duration, sum(k % 9)::double as fwd_packet_count, 0.0e0 as bwd_packet_count, sum(k % 3)::double as syn_flag_count,
 sum(case when k % 10 < 3 then 0 else value end) as packets_per_second from cs""", "packets_per_second"))
def map14(spark, d):
    m = C.map_columns_14(C.read_flow_csv(spark, write_flow_csv(spark, d)))
    return m.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("flow_duration", "fwd_packet_count", "bwd_packet_count", "syn_flag_count", "packets_per_second")])


@query("src_map_columns_proxy14", with_("ev", _CSV + """ select_final count(*) as n, avg(ln(1 + 20 + k)) as unique_dst_ports, avg(k * 2) as avg_packet_size, 1.0e0 as tcp_ratio, avg(case when 20 + k = 53 then 1.0e0 else 0 end) as dns_ratio,
 avg(least(1, (k % 3) / greatest(k % 9, 1))) as syn_ratio, avg(ln(1 + k * 1000 / 1e6)) as ip_entropy from cs""", "unique_dst_ports avg_packet_size dns_ratio syn_ratio ip_entropy"))
def proxy14(spark, d):
    m = C.map_columns_proxy14(C.read_flow_csv(spark, write_flow_csv(spark, d)))
    return m.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("unique_dst_ports", "avg_packet_size", "tcp_ratio", "dns_ratio", "syn_ratio", "ip_entropy")])


@query("src_flows_as_packets", with_("ev", """select event_id as pkt_id, concat('10.0.0.', user_id) as src_ip, '192.168.1.1' as dst_ip, (40000 + event_id % 64)::int as src_port, (20 + k)::int as dst_port, 2 as tcp_flags, case when k % 4 < 2 then 1 else 0 end as y from ev"""))
def as_packets(spark, d):
    e = B.events(spark, d)
    k, eid = F.col("k"), F.col("event_id")
    flows = e.select(eid.alias("row_id"), "ts_us", F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string")).alias("Src IP"), F.lit("192.168.1.1").alias("Dst IP"),
                     F.concat((40000 + eid % 64).cast("string"), F.lit(".0")).alias("Src Port"), (20 + k).cast("string").alias("Dst Port"),
                     F.when(k % 4 == 0, "DoS Hulk").when(k % 4 == 1, " PortScan").otherwise("benign ").alias("Label"))
    return P.flows_as_packets(flows).select("pkt_id", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "y")


# ---- sinks ------------------------------------------------------------------------------------------

@query("sink_write_alerts", with_("alerts", "select category, alert_id, severity from alerts"))
def write_alerts(spark, d):
    path = scratch(spark)
    K.write_alerts(B.alerts(spark, d), path)
    return spark.read.parquet(path).select("category", "alert_id", "severity")


_TECH = """case category when 'PORT_SCAN' then 'T1046 - Network Service Discovery' when 'SYN_FLOOD' then 'T1498.001 - DoS: Direct Flood' when 'DNS_TUNNEL' then 'T1071.004 - App Layer Protocol: DNS' when 'DNS_EXFIL' then 'T1048.003 - Exfiltration Over Alternative Protocol: DNS'
 when 'DNS_FLOOD' then 'T1071.004 - App Layer Protocol: DNS' when 'ARP_SPOOF' then 'T1557.002 - ARP Cache Poisoning' when 'BRUTE_FORCE' then 'T1110 - Brute Force' when 'TTL_ANOMALY' then 'T1090.003 - Proxy: Multi-hop Proxy' when 'PROTO_ANOMALY' then 'T1036 - Masquerading' else 'T1095 - Non-Application Layer Protocol' end"""


def _sid(kind, seed):
    return f"(select concat('{kind}--', h[1:8], '-', h[9:12], '-4', h[13:15], '-', h[1:1], h[16:16], '-', '00') from (select sha256({seed})[1:16] as h))"


def bundle(spark, d):
    return K.stix_objects(with_category_dims(B.alerts(spark, d)), F.lit(B.EPOCH_US + 300_000_000))


@query("sink_stix_objects", with_("alerts", f"""ta as (select *, {_TECH} as mitre from alerts), ids as (select alert_id, ts_us, mitre, {_sid('indicator', "concat_ws('|', category, ts_us, source_ip, description[1:50])")} as id from ta),
 fs as (select mitre, arg_min(id, (ts_us, alert_id)) as first_id from ids group by 1), ap as (select mitre, first_id, {_sid('attack-pattern', 'mitre')} as ap_id from fs), ips as (select distinct unnest([source_ip, dest_ip]) as ip from alerts)
 select_final 'identity' as kind, {_sid('identity', "'packetloom sensor'")} as id union all select 'indicator', id from ids union all select 'attack-pattern', ap_id from ap
 union all select 'relationship', {_sid('relationship', "concat_ws('|', first_id, ap_id)")} from ap union all select 'ipv4-addr', {_sid('ipv4-addr', 'ip')} from ips"""))
def stix(spark, d):
    return bundle(spark, d).select("kind", "id")


query("sink_stix_json", with_("alerts", "select concat(category, ': ', description) as name, category, ([10,25,50,75,95])[severity] as confidence, count(*) as n from alerts group by 1, 2, 3"))(
    lambda s, d: bundle(s, d).filter("kind = 'indicator'").select(F.from_json("json", "name string, confidence int, labels array<string>").alias("j"))
    .groupBy(F.col("j.name").alias("name"), F.regexp_replace(F.col("j.labels")[1], "^category:", "").alias("category"), F.col("j.confidence").alias("confidence"))
    .agg(F.count(F.lit(1)).alias("n")))


@query("sink_analytics_export")
def export(spark, d):
    p = B.packets(spark, d)
    q = B.dns_queries(spark, d).select("ts_us", "q_id", "src_ip", "name")
    from packetloom.operators.folds import active_flows
    from packetloom.operators.windows import recent_log

    return K.analytics_export(A.traffic_totals(p), A.top_senders(p), A.top_receivers(p), A.most_connected(p), A.protocol_stats(p),
                              active_flows(connections(spark, d)), dns=recent_log(q, 20, seq="q_id"))


@query("sink_window_scores", with_("packets", """w as (select ts_us - ts_us % 2000000 as window_start_us, count(*) as packets, sum(size)::bigint as bytes from packets group by 1)
 select_final window_start_us, packets, bytes, case when packets > 70 then 1 else 0 end as label from w"""))
def window_scores(spark, d):
    w = A.window_features_14(B.packets(spark, d), 2 * A.SECOND)
    scored = w.withColumns({"score": M.heuristic_score(F.array(*A.WINDOW14)), "label": F.when(F.col("packets") > 70, 1).otherwise(0)})
    path = scratch(spark)
    K.window_scores_sink(scored, path)
    back = spark.read.schema("window_start_us bigint, score double, label int, packets bigint, bytes bigint").option("header", True).csv(path)
    return back.drop("score")


@query("sink_model_baseline")
def model_baseline(spark, d):
    w = A.window_features_14(B.packets(spark, d), 2 * A.SECOND)
    scored = w.select(M.heuristic_score(F.array(*A.WINDOW14)).alias("score"))
    return K.model_baseline(w, A.WINDOW14, scored, 0.5)


@query("sink_evidence_windows", with_("packets alerts", """n as (select pkt_id, ts_us, row_number() over (order by ts_us, pkt_id) as rn from packets),
 a as (select alert_id, (select count(*) from packets p where p.ts_us <= alerts.ts_us) as last from alerts where severity >= 5)
 select_final alert_id, count(*) as packets, min(ts_us) as from_us, max(ts_us) as to_us from a join n on rn between last - 199 and last group by 1"""))
def evidence_windows(spark, d):
    from packetloom.operators.joins import packets_before

    path = scratch(spark)
    K.write_evidence(packets_before(B.packets(spark, d), B.alerts(spark, d), n=200, min_severity=5), path, clustered=True)
    return spark.read.parquet(path).groupBy("alert_id").agg(F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"))
