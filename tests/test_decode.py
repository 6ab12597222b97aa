"""Frame decoding, TLS reading and grading on literal bytes."""

from pyspark.sql import functions as F

from packetloom.functions import tls as T
from packetloom.sources import frames as L

ETH = "ffffffffffffaabbccddeeff"
IP = "4500003c1c4640004006b1e6ac100a63ac100a0c"
TCP = "c0d80050000000010000000050" + "02ffff00000000"


def frame_rows(spark, *raw):
    return spark.createDataFrame([(i, bytearray.fromhex(r)) for i, r in enumerate(raw)], "i bigint, raw binary")


def test_ipv4_tcp(spark):
    r = L.decode_l2_l4(frame_rows(spark, ETH + "0800" + IP + TCP)).first()
    assert (r.src_mac, r.ether_type, r.src_ip, r.dst_ip, r.ip_proto, r.ttl) == ("aa:bb:cc:dd:ee:ff", 0x0800, "172.16.10.99", "172.16.10.12", 6, 64)
    assert (r.src_port, r.dst_port, r.tcp_flags, r.data_offset, r.dont_fragment) == (49368, 80, 2, 20, True)


def test_padding_is_trimmed_on_request(spark):
    short = IP.replace("003c", "002a")  # 20 + 20 + 2 bytes
    f = frame_rows(spark, ETH + "0800" + short + TCP + "41420000000000")
    assert bytes(L.decode_l2_l4(f).first().payload) == b"AB"
    assert bytes(L.decode_l2_l4(f, trim=False).first().payload) == b"AB\0\0\0\0\0"


def test_vlan_ipv6_arp_and_short(spark):
    v6 = "60000000" + "0008" + "11" + "40" + "20010db8" + "00" * 11 + "01" + "20010db8" + "00" * 11 + "02" + "0035003500080000"
    arp = "0001080006040002" + "020000000001" + "0a000001" + "ffffffffffff" + "0a000002"
    rows = L.decode_l2_l4(frame_rows(spark, ETH + "8100" + "0064" + "86dd" + v6, ETH + "0806" + arp, ETH + "81000064", ETH[:10])).orderBy("i").collect()
    assert (rows[0].vlan_id, rows[0].ip_version, rows[0].src_ip, rows[0].dst_port) == (100, 6, "2001:db8:0:0:0:0:0:1", 53)
    assert (rows[1].arp_opcode, rows[1].arp_sender_ip, rows[1].arp_sender_mac) == (2, "10.0.0.1", "02:00:00:00:00:01")
    assert rows[2].ether_type is None and rows[3].ether_type is None


def test_dns_names(spark):
    q = L.read_dns(bytes.fromhex("abcd01000001000000000000" + "06") + b"google" + bytes.fromhex("03") + b"com" + bytes.fromhex("0000010001"))
    assert q["questions"] == [{"name": "google.com", "qtype": 1, "qclass": 1}] and not q["is_response"]
    loop = bytes.fromhex("abcd01000001000000000000" + "c00c" + "00010001")
    assert L.read_dns(loop)["questions"][0]["name"] == ""
    many = bytes.fromhex("abcd01000001000000000000") + b"\x01a" * 20 + b"\0\0\1\0\1"
    assert L.read_dns(many)["questions"][0]["name"].count("a") == 20  # whole names; cutting them is an option
    assert L.read_dns(many, name_steps=11)["questions"][0]["name"].count("a") == 11
    assert L.read_dns(b"short") is None and L.read_dns(None) is None


def test_http_and_ssh(spark):
    data = [(b"GET /index.html HTTP/1.1\r\nHost: example.com\r\nHost: two.com\r\n\r\nbody: x",), (b"HTTP/1.1 404 Not Found\r\nContent-Type: a:b\r\n\r\n",), (b"nothing",), (None,)]
    df = spark.createDataFrame(data, "payload binary")
    got = L.http_fields(df).select("is_request", "method", "uri", "host", "status_code", "status_text", "content_type").collect()
    assert tuple(got[0]) == (True, "GET", "/index.html", "two.com", None, None, None)
    assert tuple(got[1]) == (False, None, None, None, 404, "Not Found", "a:b")
    assert all(x is None for x in got[2]) and all(x is None for x in got[3])
    ssh = spark.createDataFrame([(b"SSH-2.0-OpenSSH_9.6\r\n",), (b"SSH-x",)], "payload binary").select(*[c.alias(n) for n, c in L.ssh_banner(F.col("payload")).items()]).collect()
    assert tuple(ssh[0]) == ("2.0", "OpenSSH_9.6") and tuple(ssh[1]) == (None, None)


def test_truncated_hello_is_no_hello():
    assert L.read_tls(bytes.fromhex("16030100050100000303")) is None
    assert L.read_tls(b"\x17\x03\x03aaaa") is None


def grade(spark, suite, version, groups):
    g = T.tls_grade(F.col("s"), F.col("v"), F.col("g"))
    return spark.createDataFrame([(suite, version, groups)], "s int, v int, g array<int>").select(*[c.alias(n) for n, c in g.items()]).first()


def test_grades(spark):
    a = grade(spark, 0x002F, 0x0302, [])
    assert (a.verdict, a.forward_secrecy, a.grade) == ("CRITICAL", False, "D")
    b = grade(spark, 0xC02F, 0x0303, None)
    assert (b.verdict, b.forward_secrecy, b.cipher_strength) == ("AT_RISK", True, "STRONG")
    c = grade(spark, 0x1301, 0x0304, [29, 0x6399])
    assert c.pq_safe and c.grade == "A+" and c.recommendations == []


def test_risk_dimension(spark):
    d = T.risk_dimension(spark)
    r = T.quantum_risk(F.col("kex"), F.col("vulnerable"))["risk"]
    got = {x.suite_id: x.risk for x in d.select("suite_id", r.alias("risk")).collect()}
    assert (got[0xC02F], got[0x1301], got[0x002F], got[0xC02B]) == ("AT_RISK", "SAFE", "CRITICAL", "AT_RISK")
