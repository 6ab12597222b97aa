"""Detection quality: confusion metrics, threshold grids, curves and per-class tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.aggregates import n_where
from packetloom.operators.ordered import order_statistics, percentile_at


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metric_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """Rates of a confusion matrix; every ratio is 0 when its base is empty."""
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    p, r, s = _ratio(a, a + b), _ratio(a, a + c), _ratio(d, d + b)
    base = F.sqrt(F.greatest((a + b) * (a + c) * (d + b) * (d + c), F.lit(1.0)))
    return {
        "precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r), "accuracy": _ratio(a + d, a + b + c + d),
        "fpr": _ratio(b, b + d), "fnr": _ratio(c, c + a), "specificity": s, "balanced_accuracy": (r + s) / 2,
        "mcc": (a * d - b * c) / base,
    }


def confusion_metrics(df: DataFrame, predicted: Column, keys=()) -> DataFrame:
    y = F.col("y") == 1
    cm = df.groupBy(*keys).agg(n_where(y & predicted).alias("tp"), n_where(~y & predicted).alias("fp"),
                               n_where(y & ~predicted).alias("fn"), n_where(~y & ~predicted).alias("tn"))
    return cm.withColumns(metric_columns())


def threshold_grid(scores: DataFrame, steps: int, low: float | None = None, high: float | None = None,
                   margin: float = 0.0) -> DataFrame:
    """Confusion counts at ``steps`` evenly spaced thresholds, from one pass over the scores.

    Each score falls into the slot of the last threshold it reaches; the slots, at most
    ``steps`` of them, are then summed from the top. Without bounds the grid spans the scores,
    widened by ``margin`` at both ends.
    """
    all_ = F.lit(0).alias("_all")
    span = scores.agg((F.min("score") - margin).alias("_lo"), (F.max("score") + margin).alias("_hi"))
    lo = F.lit(float(low)) if low is not None else F.col("_lo")
    hi = F.lit(float(high)) if high is not None else F.col("_hi")
    span = span.select(all_, lo.alias("lo"), hi.alias("hi"), ((hi - lo) / (steps - 1)).alias("step"))

    def at(i):  # the last point is the bound itself
        return F.when(i == steps - 1, F.col("hi")).otherwise(F.col("lo") + i * F.col("step"))

    s = F.col("score")
    slot = F.when(F.col("step") > 0, F.floor((s - F.col("lo")) / F.col("step"))).otherwise(F.lit(steps - 1))
    slot = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), slot))
    rows = scores.select("y", "score", all_).join(F.broadcast(span), "_all").withColumn("i", slot.cast("int"))
    # rounding may miss by one slot
    fixed = F.when((F.col("i") < steps - 1) & (at(F.col("i") + 1) <= s), F.col("i") + 1).when(
        (F.col("i") >= 0) & (at(F.col("i")) > s), F.col("i") - 1).otherwise(F.col("i"))
    slots = rows.groupBy(fixed.alias("i")).agg(n_where(F.col("y") == 1).alias("p"), n_where(F.col("y") == 0).alias("n"))
    points = span.select("lo", "hi", "step", F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("i"))
    grid = points.join(slots, "i", "left").fillna(0, ["p", "n"])
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("i"))  # steps + 1 rows
    everything = Window.partitionBy(F.lit(0))
    grid = grid.withColumns({
        "tp": F.sum("p").over(above), "fp": F.sum("n").over(above), "_p": F.sum("p").over(everything),
        "_n": F.sum("n").over(everything)}).filter("i >= 0")
    grid = grid.withColumns({"threshold": at(F.col("i")), "fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    tpr, fpr = F.col("tp") / F.greatest("_p", F.lit(1)), F.col("fp") / F.greatest("_n", F.lit(1))
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    return grid.select("i", "threshold", "tp", "fp", "fn", "tn", tpr.alias("tpr"), fpr.alias("fpr"), precision.alias("precision"))


def roc_curve(scores: DataFrame, steps: int = 200) -> DataFrame:
    return threshold_grid(scores, steps, 0.0, 1.0).select("threshold", "fpr", "tpr")


def pr_curve(scores: DataFrame, steps: int = 200) -> DataFrame:
    return threshold_grid(scores, steps, 0.0, 1.0).select("threshold", "precision", F.col("tpr").alias("recall"))


def roc_auc(grid: DataFrame) -> DataFrame:
    """Trapezoids over the grid points in order of the false-positive rate."""
    along = Window.partitionBy(F.lit(0)).orderBy("fpr", "tpr")  # as many rows as the grid
    area = (F.col("fpr") - F.lag("fpr").over(along)) * (F.col("tpr") + F.lag("tpr").over(along)) / 2
    return grid.select(area.alias("a")).agg(F.abs(F.coalesce(F.sum("a"), F.lit(0.0))).alias("auc"))


def youden_threshold(scores: DataFrame, steps: int = 500, margin: float = 0.001) -> DataFrame:
    """Largest TPR - FPR; among equals (to 6 places) the lowest false-positive rate."""
    grid = threshold_grid(scores, steps, margin=margin).withColumn("youden_j", F.col("tpr") - F.col("fpr"))
    best = grid.orderBy(F.desc(F.round("youden_j", 6)), F.round("fpr", 9), "i").limit(1)
    return best.select("threshold", "youden_j", F.col("tpr").alias("recall"), "precision", "fpr")


def recall_weighted_threshold(scores: DataFrame, weight: float = 0.8, steps: int = 200) -> DataFrame:
    """First threshold that maximises ``w recall + (1 - w) precision``."""
    grid = threshold_grid(scores, steps).withColumn("objective", weight * F.col("tpr") + (1 - weight) * F.col("precision"))
    best = grid.orderBy(F.desc(F.round("objective", 12)), "i").limit(1)
    return best.select("threshold", "objective", F.col("tpr").alias("recall"), "precision")


def contamination_threshold(scores: DataFrame, contamination: float = 0.2, bias: float = 0.8, hot_rows=None, parts=None) -> DataFrame:
    """Percentile of the scores, lowered in favour of recall."""
    base = order_statistics(scores, "score", {"base": percentile_at(1 - contamination)}, hot_rows=hot_rows, parts=parts)
    return base.select("base", (F.col("base") * (1 - (1 - bias) * 0.5)).alias("threshold"))


def per_attack_breakdown(df: DataFrame, predicted: Column, benign: str = "BENIGN") -> DataFrame:
    """Per label: rows, detected, missed, recall (for benign: specificity), mean score."""
    per = df.groupBy("label").agg(F.count(F.lit(1)).alias("total"), n_where(predicted).alias("detected"),
                                  F.avg("score").alias("mean_score"))
    ok = F.upper("label") == benign.upper()
    right = F.when(ok, F.col("total") - F.col("detected")).otherwise(F.col("detected"))
    return per.withColumns({"correct": right, "missed": F.col("total") - right, "rate": right / F.col("total")}).drop("detected")


def model_comparison(metrics: DataFrame, by: str = "recall") -> DataFrame:
    """Rank models (one row each) by recall then F1, or by F1."""
    order = [F.desc("recall"), F.desc("f1"), F.col("model")] if by == "recall" else [F.desc("f1"), F.col("model")]
    return metrics.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def rule_quality(labelled: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per category true and false positives and misses, plus an OVERALL row.

    ``labelled``: pkt_id, label (a category or BENIGN); ``alerts``: seq, category.
    """
    hits = alerts.select(F.col("seq").alias("pkt_id"), "category").distinct()
    j = labelled.join(hits, "pkt_id", "left")
    found = j.groupBy("pkt_id", "label").agg(F.max(F.coalesce(F.col("category") == F.col("label"), F.lit(False))).alias("hit"))
    attacks = found.filter("label <> 'BENIGN'").groupBy(F.col("label").alias("category")).agg(
        n_where(F.col("hit")).alias("tp"), n_where(~F.col("hit")).alias("fn"), F.lit(0).cast("bigint").alias("fp"))
    false = j.filter("category is not null and category <> label").groupBy("category").agg(
        F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fn"), F.count(F.lit(1)).alias("fp"))
    per = attacks.unionByName(false).groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])
    overall = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")]).withColumn("category", F.lit("OVERALL"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return per.unionByName(overall).withColumns({"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)})


def attack_accuracy(labelled: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per label: packets with any alert; for benign packets these are false positives."""
    alerted = alerts.select(F.col("seq").alias("pkt_id")).distinct().withColumn("_a", F.lit(True))
    j = labelled.join(alerted, "pkt_id", "left")
    per = j.groupBy("label").agg(F.count(F.lit(1)).alias("samples"), n_where(F.col("_a")).alias("detected"))
    return per.withColumns({"missed": F.col("samples") - F.col("detected"), "rate": F.col("detected") / F.col("samples")})


def top_alerts(alerts: DataFrame, n: int = 5) -> DataFrame:
    """First alert of each (category, source), earliest ``n``."""
    first = alerts.groupBy("category", "source_ip").agg(F.min(F.struct("ts_us", "seq", "severity", "description")).alias("a"))
    return first.select("category", "source_ip", "a.*").orderBy("ts_us", "seq", "category").limit(n)


def traffic_report(packets: DataFrame, alerts: DataFrame, failed: int | Column = 0) -> DataFrame:
    """Replay summary as (section, name, value): totals, alerts, protocols, senders."""
    def section(name, df, key, value):
        return df.select(F.lit(name).alias("section"), key.cast("string").alias("name"), value.cast("double").alias("value"))

    from packetloom.functions.names import severity_label
    from packetloom.operators import aggregates as A

    failed = failed if isinstance(failed, Column) else F.lit(failed)
    total = packets.agg(F.count(F.lit(1)).alias("n"))
    raised = alerts.agg(F.count(F.lit(1)).alias("n"))
    parts = [
        section("totals", total, F.lit("packets"), F.col("n")), section("totals", total, F.lit("failed"), failed),
        section("totals", raised, F.lit("alerts"), F.col("n")),
        section("severity", A.alerts_by_severity(alerts), severity_label(F.col("severity")), F.col("alerts")),
        section("category", A.alerts_by_category(alerts), F.col("category"), F.col("alerts")),
        section("top_alert", top_alerts(alerts), F.concat_ws(" ", "category", "source_ip"), F.col("seq")),
        section("protocol_pct", A.protocol_stats(packets), F.col("protocol"), F.col("share_pct")),
        section("sender_bytes", A.top_senders(packets), F.col("ip"), F.col("bytes")),
    ]
    return reduce(DataFrame.unionByName, parts)
