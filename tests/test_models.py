"""Model properties: ranges, ranking, reproducibility and coverage."""

import time

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from packetloom.operators import models as M
from packetloom.sources import bindings as B
from packetloom.streaming import streams as X


def cluster(spark, n=400):
    rng = np.random.default_rng(7)
    data = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(n)] + [(n, [9.0, 9.0, 9.0, 9.0])]
    return spark.createDataFrame(data, "row_id bigint, features array<double>")


def test_forests_isolate_the_outlier(spark):
    df = cluster(spark)
    for extension in (None, 3, 1):
        forest = M.fit_forest(df, trees=40, extension=extension, contamination=0.01)
        scored = M.predict_forest(df, forest).collect()
        assert all(0 < r.score < 1 for r in scored)
        assert max(scored, key=lambda r: r.score).row_id == 400 and sum(r.predicted for r in scored) <= 6


def test_trees_do_not_depend_on_partitions(spark):
    df = cluster(spark)
    a, b = M.fit_forest(df.repartition(1), trees=10), M.fit_forest(df.repartition(7), trees=10)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.left, b.left)


def test_pool_is_exact_and_bounded(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    pool = M.training_pool(df, "row_id", 500, 1)
    hashed = df.withColumn("h", F.xxhash64("row_id", F.lit(1))).orderBy("h").limit(500).drop("h")
    assert rows(pool) == rows(hashed)


def test_path_normalisation():
    assert (M.average_path(1), M.average_path(2)) == (0.0, 1.0)
    assert abs(M.average_path(256) - 10.244) < 0.01


def test_autoencoder_learns_and_flags(spark):
    df = cluster(spark)
    net = M.fit_autoencoder(df, epochs=12, hidden=(4, 3, 4))
    losses = [h["train_loss"] for h in net.history]
    assert losses[-1] < losses[0]
    scored = M.score_autoencoder(df, net).collect()
    assert max(scored, key=lambda r: r.error).row_id == 400 and all(0 <= r.score <= 1 for r in scored)


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = M.Autoencoder([rng.normal(size=s) for s in ((3, 2), (2, 2), (2, 3))], [rng.normal(size=n) for n in (2, 2, 3)])
    x = rng.normal(size=(5, 3))
    analytic = net.gradients(x)[0][0][1, 0]
    net.weights[0][1, 0] += 1e-6
    up = net.errors(x).sum()
    net.weights[0][1, 0] -= 2e-6
    assert abs((up - net.errors(x).sum()) / 2e-6 - analytic) < 1e-4


def test_conformal_keeps_its_promise(spark):
    s = spark.range(4000).select(F.col("id").alias("row_id"), F.rand(3).alias("score"), F.lit(0).alias("y"))
    p = M.conformal_pvalues(s.filter("row_id % 2 = 0"), s.filter("row_id % 2 = 1"))
    c = M.conformal_coverage(p)
    assert c.first().fpr_valid


def test_drift_needs_thirty(spark):
    s = spark.range(100).select((F.col("id") / 100).alias("score"))
    few, many = s.limit(29), s.limit(30)
    assert not M.ks_drift(few, s.select((F.col("score") + 5).alias("score"))).first().drift
    assert M.ks_drift(many, s.select((F.col("score") + 5).alias("score"))).first().drift


def test_retraining_waits_for_confirmations(spark):
    df = cluster(spark, 50).select("row_id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))
    assert M.retrain_with_feedback(df, df.limit(5), ["a", "b"]) is None
    stats, forest = M.retrain_with_feedback(df, df, ["a", "b"], least=10, trees=5)
    assert forest.value.shape[0] == 5 and stats.count() == 1


def test_hook_sees_transitions(spark, sf, tmp_path):
    scores = B.scores(spark, sf).withColumn("score", F.least(F.lit(1.0), F.col("score") * 3))
    scores.write.parquet(str(tmp_path / "in"))
    seen = []
    levels = X.stream_threat_levels(spark.readStream.schema(scores.schema).parquet(str(tmp_path / "in")), ttl_s=10**7)
    writer = X.on_transition(levels, lambda df, epoch: seen.append(df.count()), str(tmp_path / "c"))
    X.start(writer.trigger(availableNow=True)).awaitTermination()
    assert sum(seen) > 0


def test_state_carries_over_micro_batches(spark, sf, tmp_path):
    scores = B.scores(spark, sf)
    cuts = scores.approxQuantile("ts_us", [0.33, 0.66], 0.0)
    for low, high in zip([0, *cuts], [*cuts, 2e18]):  # one file per third, in time order
        part = scores.filter((F.col("ts_us") >= low) & (F.col("ts_us") < high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = X.run_to_table(X.stream_threat_levels(stream, ttl_s=10**7), str(tmp_path / "out"), str(tmp_path / "c"))
    from packetloom.operators.folds import threat_levels

    end = (scores.agg(F.max("ts_us")).first()[0] - 10_000_000) // 1000
    batch = threat_levels(scores).filter((F.floor(F.col("ts_us") / 1_000_000) + 1) * 1000 <= end).select("row_id", "to_level")
    assert rows(out.select("row_id", "to_level")) == rows(batch)
