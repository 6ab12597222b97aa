"""Scalar column functions: entropy, addresses, TCP flags, scores, names and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def entropy_text(text: Column) -> Column:
    """Shannon entropy in bits per character, 0 for empty or missing text.

    A character's count is how much shorter the text gets without it, which needs one step
    per distinct character: H = log2(n) - sum(c log2 c) / n.
    """
    size = F.length(text)

    def term(ch):
        c = (size - F.length(F.replace(text, ch, F.lit("")))).cast("double")
        return c * F.log2(c)

    total = F.aggregate(F.transform(distinct_characters(text), term), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(size > 0, F.log2(size.cast("double")) - total / size).otherwise(0.0)


def entropy_bytes(data: Column) -> Column:
    """Shannon entropy in bits per byte, 0 for empty or missing data."""
    return entropy_text(F.decode(data, "ISO-8859-1"))  # one character per byte


def entropy_of_counts(count: Column, total: Column) -> Column:
    """Aggregate: entropy of a distribution given per-value counts and their total."""
    p = count / total
    return -F.sum(p * F.log2(p))


def format_bytes(n: Column) -> Column:
    """One decimal; exact halves go to the even digit."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.1f PB", F.bround(n.cast("double") / 1024.0**5, 1))
    for i in range(len(units) - 1, -1, -1):
        scaled = n.cast("double") / 1024.0**i
        out = F.when(F.abs(scaled) < 1024, F.format_string(f"%.1f {units[i]}", F.bround(scaled, 1))).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    clamped = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))
    return 1.0 / (1.0 + F.exp(-clamped))


def joint_confidence(p: Column, q: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (1.0 - p) * (1.0 - q)))


def _octet(ip: Column, i: int) -> Column:
    return F.get(F.split(ip, r"\."), F.lit(i)).try_cast("bigint")


def ip_number(ip: Column) -> Column:
    """IPv4 text as a number, null when it is not an address."""
    parts = [_octet(ip, i) for i in range(4)]
    valid = reduce(lambda a, b: a & b, [p.between(0, 255) for p in parts])
    number = reduce(lambda a, b: a * 256 + b, parts)
    return F.when((F.size(F.split(ip, r"\.")) == 4) & valid, number)


def is_private_ip(ip: Column) -> Column:
    """Private or loopback; anything that does not look like IPv4 counts as private."""
    a, b = _octet(ip, 0), _octet(ip, 1)
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127)
    malformed = (F.size(F.split(ip, r"\.")) != 4) | a.isNull() | b.isNull()
    return F.when(ip.isNull() | malformed, True).otherwise(private)


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) > 0


def is_syn(flags: Column) -> Column:
    return has(flags, 2) & ~has(flags, 16)


def is_syn_ack(flags: Column) -> Column:
    return has(flags, 2) & has(flags, 16)


def is_xmas(flags: Column, strict: bool = False) -> Column:
    """Any of FIN, PSH, URG; ``strict`` asks for all three."""
    return flags.bitwiseAND(41) == 41 if strict else has(flags, 41)


def scan_type(flags: Column, strict_xmas: bool = False) -> Column:
    return (F.when(is_syn(flags), "SYN").when(flags == 1, "FIN")
            .when(is_xmas(flags, strict_xmas), "XMAS").when(flags == 0, "NULL"))


def conversation(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port") -> dict[str, Column]:
    """Direction-free endpoints: the lower (ip, port) first."""
    src = F.struct(F.col(src_ip).alias("ip"), F.col(src_port).alias("port"))
    dst = F.struct(F.col(dst_ip).alias("ip"), F.col(dst_port).alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return {"ip_low": low["ip"], "port_low": low["port"], "ip_high": high["ip"], "port_high": high["port"]}


def domain_listed(name: Column, suffixes: list[str], dot_boundary: bool = False) -> Column:
    """True when the lower-cased name ends with a listed suffix."""
    def tests(low):
        return reduce(lambda a, b: a | b, [low.endswith(s) if not dot_boundary else (low == s) | low.endswith("." + s) for s in suffixes], F.lit(False))

    return F.exists(F.array(F.lower(name)), tests)  # lower-cased once for all suffixes


def dns_labels(name: Column) -> Column:
    return F.split(name, r"\.")


def score_severity(score: Column) -> Column:
    return F.when(score >= 0.75, 5).when(score >= 0.65, 4).when(score >= 0.55, 3).otherwise(2)


def z_severity(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 5.0, 5).when(a >= 4.0, 4).when(a >= 3.0, 3).otherwise(2)


def stix_id(kind: str, *seeds: Column, uuid_shape: bool = False) -> Column:
    """Deterministic id from the first 16 hex digits of SHA-256 of the joined seeds.

    The default layout slices past those 16 digits, which leaves short last groups;
    ``uuid_shape`` fills them from the rest of the digest.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(s.cast("string"), F.lit("")) for s in seeds]), 256)
    h = digest if uuid_shape else F.substring(digest, 1, 16)

    def cut(a, b):
        return F.substring(h, a + 1, b - a)

    tail = F.substring(h, 19, 12) if not uuid_shape else F.substring(h, 19, 10)
    return F.concat(F.lit(f"{kind}--"), cut(0, 8), F.lit("-"), cut(8, 12), F.lit("-4"), cut(12, 15),
                    F.lit("-"), cut(0, 1), cut(15, 18), F.lit("-"), tail, F.lit("00"))


def stix_timestamp(ts_us: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")  # UTC whatever the session time zone
    return F.date_format(F.timestamp_add("MICROSECOND", ts_us, epoch), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def stix_pattern(category: Column, source_ip: Column, dest_ip: Column, dest_port: Column, evidence: Column) -> Column:
    """Indicator pattern of an alert category (formats are fixed values)."""
    def fmt(template, *cols):
        return F.format_string(template, *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])

    by_source = "[network-traffic:src_ref.value = '%s']"
    dns = fmt("[domain-name:value LIKE '%%' AND network-traffic:src_ref.value = '%s']", source_ip)
    return (
        F.when(category == "PORT_SCAN", fmt(
            "[network-traffic:src_ref.type = 'ipv4-addr' AND network-traffic:src_ref.value = '%s']", source_ip))
        .when(category == "SYN_FLOOD", fmt(
            "[network-traffic:dst_ref.type = 'ipv4-addr' AND network-traffic:dst_ref.value = '%s']", dest_ip))
        .when(category.isin("DNS_TUNNEL", "DNS_EXFIL"), dns)
        .when(category == "ARP_SPOOF", F.when(F.length(evidence) > 0, fmt("[mac-addr:value = '%s']", evidence))
              .otherwise("[mac-addr:value LIKE '%']"))
        .when(category == "BRUTE_FORCE", fmt(
            "[network-traffic:dst_port = %s AND network-traffic:src_ref.value = '%s']", dest_port, source_ip))
        .when(category == "ICMP_TUNNEL", fmt(
            "[network-traffic:protocols[0] = 'icmp' AND network-traffic:src_ref.value = '%s']", source_ip))
        .when(category == "PROTO_ANOMALY", fmt(by_source, source_ip))
        .when(category == "ANOMALY", "[network-traffic:src_ref.type = 'ipv4-addr']")
        .otherwise(fmt(by_source, F.coalesce(source_ip, F.lit("0.0.0.0")))))


# fixed values: dataset labels and their attack family
ATTACK_FAMILIES = {
    "BENIGN": "BENIGN", "Bot": "Botnet", "DDoS": "DDoS", "DoS GoldenEye": "DoS", "DoS Hulk": "DoS",
    "DoS Slowhttptest": "DoS", "DoS slowloris": "DoS", "FTP-Patator": "BruteForce",
    "SSH-Patator": "BruteForce", "Heartbleed": "Heartbleed", "Infiltration": "Infiltration",
    "PortScan": "PortScan",
}


# fixed values: the second naming of the families
SPACED_FAMILIES = {"BENIGN": "Benign", "Botnet": "Bot", "BruteForce": "Brute Force", "PortScan": "Port Scan", "WebAttack": "Web Attack"}


def attack_family(label: Column, spaced: bool = False) -> Column:
    """Dataset label to attack family; every ``Web Attack`` spelling is one family.
    ``spaced`` gives the names of the binary evaluation (Benign, Port Scan, ...)."""
    def named(family):
        return SPACED_FAMILIES.get(family, family) if spaced else family

    trimmed = F.trim(label)
    out = F.when(trimmed.startswith("Web Attack"), named("WebAttack"))
    for raw, family in ATTACK_FAMILIES.items():
        out = out.when(trimmed == raw, named(family))
    return out.otherwise(trimmed)


def is_attack(label: Column) -> Column:
    return F.when(F.upper(F.trim(label)) == "BENIGN", 0).otherwise(1)
