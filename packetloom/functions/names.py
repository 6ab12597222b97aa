"""Protocol name tables. All values here are fixed by the protocols or by the rule set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: protocol numbers and names
ETHER_TYPES = {0x0800: "IPv4", 0x86DD: "IPv6", 0x0806: "ARP", 0x8100: "VLAN", 0x88CC: "LLDP"}
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
ICMP_TYPES = {
    0: "Echo Reply", 3: "Dest Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo Request",
    11: "Time Exceeded", 13: "Timestamp", 14: "Timestamp Reply", 30: "Traceroute",
}
ARP_OPS = {1: "REQUEST", 2: "REPLY"}
TLS_VERSIONS = {0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
DHCP_MESSAGES = {1: "DISCOVER", 2: "OFFER", 3: "REQUEST", 4: "DECLINE", 5: "ACK", 6: "NAK", 7: "RELEASE", 8: "INFORM"}
QUIC_VERSIONS = {
    0x00000001: "QUIC v1 (RFC 9000)", 0x6B3343CF: "QUIC v2 (RFC 9369)",
    0xFF000020: "QUIC draft-32", 0xFF00001D: "QUIC draft-29",
}
SERVICES = {
    22: "SSH", 3389: "RDP", 21: "FTP", 23: "Telnet", 5900: "VNC", 3306: "MySQL", 5432: "PostgreSQL",
    1433: "MSSQL", 27017: "MongoDB",
}
SEVERITIES = {1: "INFO", 2: "LOW", 3: "MEDIUM", 4: "HIGH", 5: "CRITICAL"}
SEVERITY_ICONS = {1: "i", 2: "!", 3: "!!", 4: "!!!", 5: "!!!!"}
STIX_CONFIDENCE = {1: 10, 2: 25, 3: 50, 4: 75, 5: 95}
CIPHER_SUITES = {
    0x0000: "TLS_NULL_WITH_NULL_NULL",
    0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA",
    0x0033: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA",
    0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA",
    0x0039: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA",
    0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256",
    0x003D: "TLS_RSA_WITH_AES_256_CBC_SHA256",
    0x0067: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA256",
    0x006B: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA256",
    0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256",
    0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384",
    0x009E: "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256",
    0x009F: "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384",
    0x1301: "TLS_AES_128_GCM_SHA256",
    0x1302: "TLS_AES_256_GCM_SHA384",
    0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0x1304: "TLS_AES_128_CCM_SHA256",
    0x1305: "TLS_AES_128_CCM_8_SHA256",
    0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA",
    0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA",
    0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA",
    0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256",
    0xC024: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384",
    0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256",
    0xC028: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384",
    0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256",
    0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
    0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256",
    0xCCAC: "TLS_ECDHE_PSK_WITH_CHACHA20_POLY1305_SHA256",
}
# fixed values: suites the quantum-risk inventory knows
RISK_SUITES = [
    0x002F, 0x0035, 0x003C, 0x003D, 0x009C, 0x009D, 0xC013, 0xC014, 0xC027, 0xC028, 0xC02F, 0xC030,
    0xC009, 0xC00A, 0xC023, 0xC024, 0xC02B, 0xC02C, 0xCCA8, 0xCCA9, 0x1301, 0x1302, 0x1303,
]
PQ_GROUPS = [0x6399, 0x639A]
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128, "NS": 256}


def lookup(table: dict, key: Column, default: Column) -> Column:
    """``table[key]`` as a case expression, ``default`` when absent."""
    return reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), None)).otherwise(default)


def hex_name(value: Column, digits: int = 4) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(value), digits, "0"))


def ether_type_name(c: Column) -> Column:
    return lookup(ETHER_TYPES, c, hex_name(c))


def ip_protocol_name(c: Column) -> Column:
    return lookup(IP_PROTOCOLS, c, c.cast("string"))


def icmp_type_name(c: Column) -> Column:
    return lookup(ICMP_TYPES, c, F.concat(F.lit("Type_"), c.cast("string")))


def arp_op_name(c: Column) -> Column:
    return lookup(ARP_OPS, c, c.cast("string"))


def tls_version_name(c: Column) -> Column:
    return lookup(TLS_VERSIONS, c, hex_name(c))


def cipher_suite_name(c: Column) -> Column:
    return lookup(CIPHER_SUITES, c, hex_name(c))


def dns_type_name(c: Column) -> Column:
    return lookup(DNS_TYPES, c, F.concat(F.lit("TYPE"), c.cast("string")))


def dns_rcode_name(c: Column) -> Column:
    return lookup(DNS_RCODES, c, F.concat(F.lit("RCODE"), c.cast("string")))


def dhcp_message_name(c: Column) -> Column:
    return lookup(DHCP_MESSAGES, c, F.coalesce(c.cast("string"), F.lit("UNKNOWN")))


def quic_version_name(c: Column) -> Column:
    return lookup(QUIC_VERSIONS, c, hex_name(c, 8))


def service_name(c: Column) -> Column:
    return lookup(SERVICES, c, c.cast("string"))


def severity_label(c: Column) -> Column:
    return lookup(SEVERITIES, c, c.cast("string"))


def severity_icon(c: Column) -> Column:
    return lookup(SEVERITY_ICONS, c, F.lit(""))


def stix_confidence(c: Column) -> Column:
    return lookup(STIX_CONFIDENCE, c, F.lit(50))


def flag_names(flags: Column) -> Column:
    """Names of the set TCP flags joined by ``|``, NONE when no flag is set."""
    names = F.concat_ws("|", *[F.when(flags.bitwiseAND(bit) > 0, n) for n, bit in FLAG_BITS.items()])
    return F.when(names == "", "NONE").otherwise(names)
