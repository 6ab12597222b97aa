"""No caps: whole names, heads and records, exact pools, chains that show a lost segment, one Python pass per decoder."""

import struct

import pytest
from pyspark.sql import functions as F

from helpers import rows
from packetloom.functions import scalars as S
from packetloom.operators import models as M
from packetloom.operators import windows as W
from packetloom.sources import flows_csv as C
from packetloom.sources import frames as L
from packetloom.sources import sinks as K


def _encoded(name):
    return b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"


def test_long_dns_names_and_txt_strings():
    name = ".".join("0123456789abcdef" * 2) + ".ip6.arpa"
    txt = b"\x03one\x04 two"
    msg = struct.pack("!6H", 7, 0x8180, 1, 1, 0, 0) + _encoded(name) + struct.pack("!HH", 12, 1)
    msg += b"\xc0\x0c" + struct.pack("!HHIH", 16, 1, 60, len(txt)) + txt
    got = L.read_dns(msg)
    assert got["questions"] == [{"name": name, "qtype": 12, "qclass": 1}]
    assert got["answers"][0]["name"] == name and got["answers"][0]["rdata"] == "one two"
    loop = struct.pack("!6H", 7, 0, 1, 0, 0, 0) + b"\x01a\xc0\x0c" + struct.pack("!HH", 1, 1)
    assert L.read_dns(loop)["questions"][0]["qtype"] in (1, 0xC00C)  # a pointer in a circle ends the name


def test_long_http_head(spark):
    head = "GET / HTTP/1.1\r\nHost: h\r\n" + "".join(f"X-{k}: {'v' * 90}\r\n" for k in range(200)) + "Last: yes"
    df = spark.createDataFrame([(bytearray(head.encode()),)], "payload binary")
    assert L.http_fields(df).first().headers["last"] == "yes"
    assert "last" not in L.http_fields(df, head_bytes=8192).first().headers


@pytest.mark.parametrize("size", range(1, 9))
def test_training_pool_is_exact(spark, size):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    for seed in range(4):
        want = [r.row_id for r in df.withColumn("h", F.xxhash64("row_id", F.lit(seed))).orderBy("h").limit(size).collect()]
        assert sorted(r.row_id for r in M.training_pool(df, "row_id", size, seed).collect()) == sorted(want)


def test_format_bytes_halves_go_to_even(spark):
    sizes = [1280, 1344, 1408, 1152, 1023, 1024 * 1024 + 51 * 1024 + 205]
    got = [r.t for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(S.format_bytes(F.col("n")).alias("t")).collect()]
    assert got[:5] == ["1.2 KB", "1.3 KB", "1.4 KB", "1.1 KB", "1023.0 B"]


def test_a_lost_moved_or_added_segment_shows(spark):
    log = spark.range(95).select(F.lit("log").alias("log_id"), F.col("id").alias("ts_us"), F.col("id").alias("row_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"))
    chain = spark.createDataFrame(K.audit_chain(log, "g", segment_rows=10).collect())

    def intact(df):
        return all(r.intact for r in W.verify_audit_chain(df, "g").collect())

    assert intact(chain)
    assert not intact(chain.filter("segment <> 4"))
    assert not intact(chain.filter("segment < 9"))  # the end is missing
    assert not intact(chain.withColumn("segment", F.when(F.col("segment") == 3, 4).when(F.col("segment") == 4, 3).otherwise(F.col("segment"))))
    assert not intact(chain.filter("segment <> 4").withColumn("segment", F.when(F.col("segment") > 4, F.col("segment") - 1).otherwise(F.col("segment"))))
    assert not intact(chain.unionByName(chain.filter("segment = 2").withColumn("segment", F.lit(11).cast("long"))))
    assert not intact(chain.withColumn("payload", F.when((F.col("segment") == 5) & (F.col("seq") == 3), "x").otherwise(F.col("payload"))))


def test_quoted_header_names(spark, tmp_path):
    (tmp_path / "f.csv").write_text('"Flow, Duration", Rate,Label\n5,2.5,BENIGN\n')
    got = C.read_flow_csv(spark, str(tmp_path / "f.csv"))
    assert got.columns == ["Flow, Duration", "Rate", "label", "y"]
    assert rows(got.select(F.col("`Flow, Duration`").alias("a"), F.col("Rate").alias("b"), F.col("label").alias("c"))) == [(5.0, 2.5, "BENIGN")]


def test_one_python_pass(spark):
    df = spark.createDataFrame([("DNS", bytearray(40)), ("TLS", bytearray(4))], "protocol string, payload binary")
    plan = L.decode_l7(df).filter("dns is not null").select("dns.txid", F.size("dns.questions"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
