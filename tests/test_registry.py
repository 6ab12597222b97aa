"""The driver contract: names line up, and a sample of queries matches DuckDB on the spot."""

import duckdb
import pytest

import __spark_entry__ as entry
from helpers import cell

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
SAMPLE = ["agg_flow_features_14", "agg_window_features_14", "detect_port_scan", "fold_incidents", "fold_tcp_connections",
          "join_rule_ml_interval", "eval_youden_threshold_500", "model_ks_drift_shifted", "src_decode_dns", "src_read_flow_csv",
          "sink_stix_objects", "stream_incidents"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 150


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns[:2] == ["seq", "ts_us"] and found.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols

    def norm(v):
        v = cell(v)
        return round(v, 6) if isinstance(v, float) else v

    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
    assert got == want
