"""TLS columns: JA3 fingerprints, handshake grading and quantum risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.names import CIPHER_SUITES, PQ_GROUPS, RISK_SUITES, hex_name, lookup
from packetloom.session import literal_table

# fixed values: reserved GREASE code points, 0x0A0A to 0xFAFA
GREASE = [0x0A0A + 0x1010 * i for i in range(16)]


def _plain(ids: Column) -> Column:
    return F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda x: ~x.isin(GREASE))


def _dashed(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), "-")


def ja3_string(version, suites, extensions, groups, point_formats) -> Column:
    points = F.coalesce(point_formats, F.array().cast("array<int>"))
    return F.concat_ws(
        ",", version.cast("string"), _dashed(_plain(suites)), _dashed(F.array_sort(_plain(extensions))),
        _dashed(_plain(groups)), _dashed(points))


def ja3(version, suites, extensions, groups, point_formats) -> Column:
    return F.md5(ja3_string(version, suites, extensions, groups, point_formats))


def hello_version(version: Column, supported: Column) -> Column:
    """The version a ClientHello offers: its highest supported version when it lists any."""
    return F.when(F.size(supported) > 0, F.array_max(supported)).otherwise(version)


def has_post_quantum(groups: Column) -> Column:
    return F.coalesce(F.arrays_overlap(groups, F.array(*[F.lit(g) for g in PQ_GROUPS])), F.lit(False))


# fixed values: key exchange by name fragment, first match wins
_KEX = [
    ("ECDHE_RSA", "ECDHE-RSA", True, 256), ("ECDHE_ECDSA", "ECDHE-ECDSA", True, 256),
    ("DHE_RSA", "DHE-RSA", True, 2048), ("RSA", "RSA", False, 2048),
]
# fixed values: bulk cipher by name fragment, first match wins
_BULK = [
    ("AES_256_GCM", "AES-256-GCM", "STRONG", 256, "AEAD"),
    ("AES_128_GCM", "AES-128-GCM", "STRONG", 128, "AEAD"),
    ("CHACHA20_POLY1305", "ChaCha20-Poly1305", "STRONG", 256, "AEAD"),
    ("AES_256_CBC", "AES-256-CBC", "MODERATE", 256, "CBC"),
    ("AES_128_CBC", "AES-128-CBC", "MODERATE", 128, "CBC"),
    ("AES_128_CCM", "AES-128-CCM", "STRONG", 128, "AEAD"),
    ("NULL", "NULL", "BROKEN", 0, "None"),
]
# fixed values: protocol version, name and risk
_VERSIONS = {
    0x0300: ("SSL 3.0", "BROKEN"), 0x0301: ("TLS 1.0", "DEPRECATED"), 0x0302: ("TLS 1.1", "DEPRECATED"),
    0x0303: ("TLS 1.2", "LEGACY"), 0x0304: ("TLS 1.3", "CURRENT"),
}


def _first(name: Column, rows, field: int, default, start=None) -> Column:
    out = start
    for row in rows:
        hit, value = name.contains(row[0]), F.lit(row[field])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default))


def tls_grade(suite: Column, version: Column, groups: Column | None = None) -> dict[str, Column]:
    """Named columns that grade a handshake: key exchange, cipher, version, quantum verdict."""
    name = lookup(CIPHER_SUITES, suite, F.concat(F.lit("UNKNOWN_"), hex_name(suite)))
    modern = (version == 0x0304) | name.startswith("TLS_AES_") | name.startswith("TLS_CHACHA20_")
    kex = _first(name, _KEX, 1, "UNKNOWN", F.when(modern, "TLS1.3-ECDHE"))
    forward = _first(name, _KEX, 2, False, F.when(modern, True))
    kex_bits = _first(name, _KEX, 3, 0, F.when(modern, 256))
    cipher, strength = _first(name, _BULK, 1, "UNKNOWN"), _first(name, _BULK, 2, "UNKNOWN")
    bits, mode = _first(name, _BULK, 3, 0), _first(name, _BULK, 4, "UNKNOWN")
    version_name = lookup({k: v[0] for k, v in _VERSIONS.items()}, version, hex_name(version))
    version_risk = lookup({k: v[1] for k, v in _VERSIONS.items()}, version, F.lit("UNKNOWN"))
    safe = has_post_quantum(groups) if groups is not None else F.lit(False)
    verdict = F.when(safe, "SAFE").when(kex.contains("RSA") & ~forward, "CRITICAL").otherwise("AT_RISK")
    points = (F.when(version_risk == "CURRENT", 3).when(version_risk == "LEGACY", 2).otherwise(0)
              + F.when(strength == "STRONG", 3).when(strength == "MODERATE", 2).otherwise(0)
              + F.when(forward, 2).otherwise(0) + F.when(safe, 2).otherwise(0))
    grade = reduce(lambda acc, g: acc.when(points >= g[0], g[1]),
                   [(8, "A"), (6, "B"), (4, "C"), (2, "D")], F.when(points >= 10, "A+")).otherwise("F")
    advice = F.array_compact(F.array(
        F.when(version_risk == "LEGACY", "Offer TLS 1.3")
        .when(version_risk != "CURRENT", "Retire the deprecated TLS version"),
        F.when(strength == "MODERATE", F.concat(F.lit("Move from "), cipher, F.lit(" to an AEAD cipher")))
        .when(strength != "STRONG", F.concat(F.lit("Replace "), cipher)),
        F.when(~forward, "Prefer ephemeral key exchange"),
        F.when(~safe, "Add a hybrid post-quantum group")))
    return {
        "suite_name": name, "kex": kex, "kex_bits": kex_bits, "forward_secrecy": forward,
        "cipher": cipher, "cipher_strength": strength, "cipher_bits": bits, "cipher_mode": mode,
        "version_name": version_name, "version_risk": version_risk, "pq_safe": safe,
        "verdict": verdict, "grade": grade, "recommendations": advice,
    }


def risk_dimension(spark):
    """Known suites as a table: id, name, key exchange, vulnerable to a quantum attacker."""
    rows = []
    for sid in RISK_SUITES:
        name = CIPHER_SUITES[sid]
        kex = name.removeprefix("TLS_").split("_WITH_")[0] if "_WITH_" in name else "TLS1.3"
        rows.append((sid, name, kex, kex != "TLS1.3"))
    return literal_table(spark, rows, "suite_id int, suite_name string, kex string, vulnerable boolean")


def quantum_risk(kex: Column, vulnerable: Column) -> dict[str, Column]:
    """Risk level and advice after a left join with the dimension; no match is AT_RISK."""
    risk = (F.when(vulnerable.isNull(), "AT_RISK").when(~vulnerable, "SAFE")
            .when(kex == "RSA", "CRITICAL").otherwise("AT_RISK"))
    advice = (F.when(vulnerable.isNull(), "Unknown suite: treat as vulnerable and move to TLS 1.3 with hybrid key exchange")
              .when(~vulnerable, "Ephemeral keys; plan hybrid key exchange")
              .otherwise(F.concat(F.lit("Key exchange "), kex, F.lit(" falls to Shor's algorithm; use a hybrid one"))))
    return {"risk": risk, "advice": advice}
