"""Work that grows with its input: stretches of a hot key, evidence without shuffled pairs, folds by buckets, batches of many files."""

import random

from helpers import rows
from pyspark.sql import functions as F

from packetloom.operators import joins as J
from packetloom.operators import ordered
from packetloom.operators.ordered import sliding_sums
from packetloom.plans.live import in_turn
from packetloom.sources import sinks as K
from packetloom.streaming import streams as X

SECOND = 1_000_000


def test_a_hot_key_is_summed_by_stretches_of_time(spark, monkeypatch):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([rng.randrange(-2000, 2000), 160 * rng.randrange(-9, 9) + rng.choice([-10, -9, 0])]), k, rng.randrange(5))
            for k in range(1500)] + [("a", None, 9001, 1), ("a", None, 9002, 1)]
    df = spark.createDataFrame(data, "k string, t long, s long, v int")
    sums = {"n": F.lit(1), "x": F.col("v")}
    plain = rows(sliding_sums(df, ["k"], "t", "s", 10, sums, False))
    want = {s: sum(k2 == k and t2 is not None and t - 10 < t2 and (t2, s2) <= (t, s) for k2, t2, s2, _ in data) for k, t, s, _ in data if t is not None}
    got = sliding_sums(df, ["k"], "t", "s", 10, sums, 200)
    assert {r.s: r.n for r in got.filter("t is not null").collect()} == want
    known = df.filter("t is not null")
    cut = rows(sliding_sums(known, ["k"], "t", "s", 10, sums, 1, 5))  # stretches that are hot themselves
    monkeypatch.setattr(ordered, "durable", lambda _: 1 / 0)  # no copy of the rows
    assert rows(sliding_sums(df, ["k"], "t", "s", 10, sums, 200)) == rows(sliding_sums(df, ["k"], "t", "s", 10, sums, True)) == plain
    assert cut == rows(sliding_sums(known, ["k"], "t", "s", 10, sums, 200))


def test_evidence_is_paired_after_the_last_shuffle(spark, tmp_path):
    rng = random.Random(5)
    p = [(k, rng.randrange(900)) for k in range(700)]
    a = [(k % 60, rng.randrange(-20, 1000), rng.randrange(3, 6)) for k in range(80)]  # some ids come twice
    packets, alerts = spark.createDataFrame(p, "pkt_id long, ts_us long"), spark.createDataFrame(a, "alert_id long, ts_us long, severity int")
    found = J.packets_before(packets, alerts, 30, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.split("Generate inline")[0] and "Join" not in plan.split("Generate inline")[0]
    K.write_evidence(found, str(tmp_path / "e"), clustered=True)
    got = rows(spark.read.parquet(str(tmp_path / "e")).select("alert_id", "pkt_id", "ts_us", "age"))
    inside = sorted((t, k) for k, t in p)
    want = []
    for alert, at, severity in a:
        if severity >= 4:
            want += [(age, alert, k, t) for age, (t, k) in enumerate([x for x in inside if x[0] <= at][::-1][:30], 1)]
    assert got == sorted(want, key=repr)


def _batches(spark, data, tmp_path, **kw):
    seen = []
    stream = in_turn(spark, spark.createDataFrame(data, "k string, ts_us long, v long").repartition(7), **kw)

    def take(batch, epoch):
        seen.append(sorted((r.k or "", r.ts_us, r.v) for r in batch.collect()))

    stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_batches_of_many_files_hold_one_span_each(spark, tmp_path):
    rng = random.Random(6)
    data = [("a", rng.randrange(100 * SECOND), k) for k in range(400)] + [("b", 0, 401), ("b", 400 * SECOND, 402)]  # the spans after the first are all but empty
    seen = _batches(spark, data, tmp_path, file_rows=20)
    assert len(seen) == 4 and sum(map(len, seen)) == 402
    assert [len({v for _, _, v in b}) for b in seen[1:]] == [len(seen[1]), 0, 1] and seen[3] == [("b", 400 * SECOND, 402)]
    assert all(ts % 10 == 0 for _, ts, _ in seen[1])


def test_folds_of_many_keys_share_processors(spark, tmp_path):
    rng = random.Random(7)
    keys = [f"k{i}" for i in range(60)] + [None]
    data = [(rng.choice(keys), rng.randrange(200 * SECOND), k) for k in range(3000)]
    stream = in_turn(spark, spark.createDataFrame(data, "k string, ts_us long, v long"), file_rows=100)
    fold = X.stream_fold(stream, ["k"], ["_position", "v"], lambda s, n, v: (((s or 0) * 31 + v) % 1009, (n, (s or 0))), "n bigint, before bigint", "s bigint",
                         order=("ts_us", "v"), ttl_s=20, buckets=3)
    query = X.start(fold.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True))
    query.awaitTermination()
    got = sorted((r.k or "", r.ts_us, r.v, r.n, r.before) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    closed, want = (max(t for _, t, _ in data) - 10 * SECOND) // SECOND, []
    for key in keys:
        n, s, last = 0, 0, None
        for _, t, v in sorted((x for x in data if x[0] == key), key=lambda x: x[1:]):
            if last is not None and t - last > 20 * SECOND:
                n, s = 0, 0
            n, last = n + 1, t
            if t // SECOND < closed:
                want.append((key or "", t, v, n, s))
            s = (s * 31 + v) % 1009
    assert got == sorted(want) and len(got) > 2500
