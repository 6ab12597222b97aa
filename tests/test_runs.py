"""Folds on cut keys: transfer maps against plain folds, busy keys without pauses, sudden values, null keys."""

import json
import math
import random

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.operators import folds as X
from packetloom.operators import runs as R


def folded(step, state, values):
    for v in values:
        state, _ = step(state, *v)
    return state


def summed(summary, values):
    acc = summary.identity()
    for v in values:
        acc = json.loads(json.dumps(summary.then(acc, *v)))
    return acc


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3_000_000), min_size=2, max_size=60), st.integers(1, 58), st.sampled_from([0.2, 0.5, 1.0, 3.0, 10.0]), st.integers(1, 6))
def test_bucket_maps_are_exact(gaps, cut, rate, burst):
    ts = [sum(gaps[: k + 1]) for k in range(len(gaps))]
    cut = min(cut, len(ts) - 1)
    units = R.TokenUnits(rate, burst)
    head = folded(units.step, None, [(t,) for t in ts[:cut]])
    tail = summed(units, [(t,) for t in ts[cut:]])
    assert units.apply(tail, head) == folded(units.step, head, [(t,) for t in ts[cut:]])
    assert units.apply(summed(units, [(t,) for t in ts]), None) == folded(units.step, None, [(t,) for t in ts])
    assert burst == 1 or len(tail[2]) <= 2 * burst + 3  # pieces do not grow with the rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=80), st.integers(1, 78), st.integers(0, 30), st.sampled_from([0.01, 0.1, 0.6]))
def test_moments_maps(values, cut, warmup, alpha):
    cut = min(cut, len(values) - 1)
    pairs = [(k + 1, v) for k, v in enumerate(values)]
    step, summary = X.ewma_step(alpha, warmup), R.SmoothedMoments(alpha, warmup)
    head = folded(step, None, pairs[:cut])
    got, want = summary.apply(summed(summary, pairs[cut:]), head), folded(step, None, pairs)
    assert got[0] == want[0] and len(got[3]) == len(want[3])
    for a, b in zip(got[1:3], want[1:3]):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40), st.floats(0.01, 0.3))
def test_clamped_maps(rates, c):
    def step(c, rate):
        return max(0.01, min(0.3, 0.15 * rate + 0.85 * c)), None

    summary = R.ClampedSmoothing(0.15, 0.01, 0.3)
    assert math.isclose(summary.apply(summed(summary, [(r,) for r in rates]), c), folded(step, c, [(r,) for r in rates]), rel_tol=1e-12)


def busy(spark, n, every=1_000, seed=1):
    """One key with an event in every millisecond or so, never a pause; a second key with few, and one without a name."""
    gap = (F.xxhash64("id", F.lit(seed)) % every + every) % every + 1
    one = spark.range(n).select(F.when(F.col("id") % 997 == 5, "quiet").when(F.col("id") % 499 == 7, None).otherwise("busy").alias("who"),
                                (F.col("id") * every + gap).alias("ts_us"), F.col("id").alias("seq"))
    return one


@pytest.mark.parametrize("seconds", [0.0005, 0.003, 0.7, 30.0])
def test_intervals_on_a_busy_key(spark, seconds):
    df = busy(spark, 4000)
    plain = rows(X.cooldown(df, ["who"], seconds, hot_rows=False))
    assert plain == rows(X.cooldown(df, ["who"], seconds, hot_rows=True, parts=7))


def test_intervals_with_equal_times(spark):
    df = busy(spark, 3000).withColumn("ts_us", F.floor(F.col("ts_us") / 50_000) * 50_000)
    for seconds in (0.0, 0.12):
        assert rows(X.cooldown(df, ["who"], seconds, hot_rows=False)) == rows(X.cooldown(df, ["who"], seconds, hot_rows=True, parts=9))


@pytest.mark.parametrize("rate, burst", [(300.0, 5), (900.0, 3), (0.2, 2), (1000.0, 1)])
def test_a_bucket_on_a_busy_key(spark, rate, burst):
    df = busy(spark, 4000)
    plain = rows(X.token_bucket(df, ["who"], rate, burst, hot_rows=False))
    assert plain == rows(X.token_bucket(df, ["who"], rate, burst, hot_rows=True, parts=7))
    assert {r[0] for r in plain} == {True, False}


def test_two_million_rows_of_one_key(spark):
    df = busy(spark, 2_000_000)
    kept = X.cooldown(df, ["who"], 0.25, hot_rows=True, parts=16).filter("who = 'busy'")
    got = [r.ts_us for r in kept.select("ts_us").orderBy("ts_us").collect()]
    ts = sorted(df.filter("who = 'busy'").select("ts_us").toArrow().column(0).to_pylist())
    want, free = [], None
    for t in ts:
        if free is None or t >= free:
            want.append(t)
            free = t + 250_000
    assert got == want
    allowed = X.token_bucket(df, ["who"], 100.0, 20, hot_rows=True, parts=16).filter("who = 'busy' and allowed").count()
    units, state, n = R.TokenUnits(100.0, 20), None, 0
    for t in ts:
        state, (ok, _) = units.step(state, t)
        n += ok
    assert allowed == n


def test_one_huge_early_value(spark):
    rng = random.Random(3)
    series = [("m", k * 1000, 1e12 if k == 30 else 50 + rng.gauss(0, 1)) for k in range(3000)] + [("short", k, float(k)) for k in range(5)]
    df = spark.createDataFrame(series, "metric string, ts_us long, value double")
    for against in ("updated", "prior"):
        plain, cut = (X.ewma_zscore(df, 0.05, against=against, hot_rows=h, parts=8).orderBy("metric", "ts_us").collect() for h in (False, True))
        assert len(plain) == len(cut) == len(series)
        for a, b in zip(plain, cut):
            for x, y in ((a.mean, b.mean), (a.std, b.std), (a.z, b.z)):
                assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))


def test_a_warm_up_longer_than_a_run(spark):
    series = spark.range(60).select(F.lit("m").alias("metric"), F.col("id").alias("ts_us"), (F.col("id") % 7).cast("double").alias("value"))
    assert rows(X.ewma_zscore(series, warmup=25, hot_rows=False)) == rows(X.ewma_zscore(series, warmup=25, hot_rows=True, parts=20))


def test_drift_alerts_in_cut_runs(spark):
    rng = random.Random(6)
    series = [("d", k, rng.random() + (k // 700) * 0.4) for k in range(3500)]
    df = spark.createDataFrame(series, "detector string, ts_us long, score double")
    plain, cut = (rows(X.page_hinkley(df, threshold=3.0, hot_rows=h, parts=9)) for h in (False, True))
    assert plain == cut and 2 < sum(r[2] for r in plain) < 200
