"""Sliding rates, streaks, trends and per-key sequence checks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.ordered import OrderedGroups, Running, sliding_sums
from packetloom.operators.runs import fold_rows

SECOND = 1_000_000


def rolling_rate(packets, width_us: int = 5 * SECOND, keys=(), capped_by_uptime: bool = False,
                 hot_rows=None, parts=None) -> DataFrame:
    """Bytes and packets per second over (t - w, t] at every time a packet arrives."""
    keys = list(keys)
    ticks = packets.groupBy(*keys, "ts_us").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_b"))
    ticks = ticks.withColumn("_one", F.lit(0))
    out = sliding_sums(ticks, keys, "ts_us", "_one", width_us,
                       {"packets": F.col("_n"), "bytes": F.col("_b")}, hot_rows, parts)
    seconds = F.lit(width_us / SECOND)
    if capped_by_uptime:  # divide by the time since the first packet while that is shorter
        first = packets.agg(F.min("ts_us").alias("_first")).withColumn("_all", F.lit(0))
        out = out.withColumn("_all", F.lit(0)).join(F.broadcast(first), "_all").drop("_all")
        up = (F.col("ts_us") - F.col("_first")) / SECOND
        seconds = F.greatest(F.least(seconds, up), F.lit(0.001))
    return out.withColumns({"packets_per_second": F.col("packets") / seconds,
                            "bytes_per_second": F.col("bytes") / seconds}).select(
        *keys, "ts_us", "packets", "bytes", "packets_per_second", "bytes_per_second")


def top_connections(packets, at_us: Column, width_us: int = 5 * SECOND, top: int = 10) -> DataFrame:
    """Directional connections with most bytes per second in (at - w, at]."""
    conn = F.format_string("%s:%d<->%s:%d", "src_ip", "src_port", "dst_ip", "dst_port")
    recent = packets.filter((F.col("ts_us") > at_us - width_us) & (F.col("ts_us") <= at_us))
    return (recent.groupBy(conn.alias("connection"))
            .agg((F.sum("size") / (width_us / SECOND)).alias("bytes_per_second"))
            .filter("bytes_per_second > 0").orderBy(F.desc("bytes_per_second"), "connection").limit(top))


def value_change(df, keys, order, value: str, hot_rows=None, parts=None) -> DataFrame:
    """Rows whose ``value`` differs from the previous row of the key."""
    seen = OrderedGroups(df, keys, order, hot_rows, parts).previous(previous_value=F.col(value)).df
    return seen.filter(F.col("previous_value").isNotNull() & (F.col("previous_value") != F.col(value)))


def pq_trend(sessions: DataFrame) -> DataFrame:
    """Per host: the last ten sessions against the ten before."""
    newest = Window.partitionBy("host_ip").orderBy(F.desc("ts_us"), F.desc("sess_id"))
    # the limit on row_number is applied before the shuffle too, so a hot host stays small
    last20 = sessions.withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 20")
    pq = F.col("has_pq").cast("int")
    per = last20.groupBy("host_ip").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.when(F.col("_rn") <= 10, pq)), F.lit(0)).alias("recent_pq"),
        F.coalesce(F.sum(F.when(F.col("_rn") > 10, pq)), F.lit(0)).alias("previous_pq"))
    diff = F.col("recent_pq") - F.col("previous_pq")
    trend = (F.when(F.col("_n") < 10, "UNKNOWN")
             .when(F.col("_n") < 20, F.when(F.col("recent_pq") >= 5, "IMPROVING").otherwise("STABLE"))
             .when(diff >= 2, "IMPROVING").when(diff <= -2, "DEGRADING").otherwise("STABLE"))
    return per.select("host_ip", "recent_pq", "previous_pq", trend.alias("trend"))


def score_trend(scores, n: int = 10, hot_rows=None, parts=None) -> DataFrame:
    """Least-squares slope per second and moments over the last ``n`` scores of each flow."""
    groups = OrderedGroups(scores, ["flow_key"], ["ts_us", "row_id"], hot_rows, parts)

    def compute(w):
        last, three = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-2, 0)
        seconds = (F.col("ts_us") - F.col("_t0")) / SECOND
        count, s = F.count(F.lit(1)).over(last), F.col("score")
        spread = F.regr_sxx(s, seconds).over(last)
        slope = F.regr_slope(s, seconds).over(last)
        return {
            "trend": F.when((count < 2) | (spread < 1e-12), 0.0).otherwise(F.coalesce(slope, F.lit(0.0))),
            "mean_score": F.avg(s).over(last), "max_score": F.max(s).over(last),
            "variance": F.when(count < 2, 0.0).otherwise(F.var_pop(s).over(last)),
            "recent_mean": F.avg(s).over(three), "buffer_size": count,
        }

    def prepare(w):  # times relative to the first row keep the sums small
        return {"_t0": F.min("ts_us").over(w.rowsBetween(Window.unboundedPreceding, 0))}

    return groups.over_last(n, compute, prepare=prepare).drop("_t0")


def trend_alerts(trends: DataFrame, slope: float = 0.015, mean: float = 0.35, fill: int = 3) -> DataFrame:
    return trends.filter((F.col("buffer_size") >= fill) & (F.col("trend") > slope) & (F.col("mean_score") > mean))


def latest_per_flow(trends: DataFrame) -> DataFrame:
    cols = [c for c in trends.columns if c != "flow_key"]
    last = trends.groupBy("flow_key").agg(F.max_by(F.struct(*cols), F.struct("ts_us", "row_id")).alias("r"))
    return last.select("flow_key", "r.*")


def top_trending(trends: DataFrame, n: int = 10, fill: int = 3) -> DataFrame:
    return (latest_per_flow(trends).filter(F.col("buffer_size") >= fill)
            .orderBy(F.desc("trend"), "flow_key").limit(n))


def _streaks(scores, below: float, hot_rows, parts) -> OrderedGroups:
    groups = OrderedGroups(scores, ["flow_key"], ["ts_us", "row_id"], hot_rows, parts).numbered("_rn")
    broken = F.when(F.col("score") >= below, F.col("_rn"))
    groups = groups.running(_reset=Running("max", broken))
    streak = F.col("_rn") - F.coalesce("_reset", F.lit(0))
    return groups.derive(lambda d: d.withColumn("streak", streak).drop("_rn", "_reset"))


def low_streak(scores, below: float = 0.35, hot_rows=None, parts=None) -> DataFrame:
    """Length of the current run of scores under ``below``."""
    return _streaks(scores, below, hot_rows, parts).df


def online_pvalue(scores, n: int = 500, epsilon: float = 0.05, hot_rows=None, parts=None) -> DataFrame:
    """Conformal p-value of each score against the ``n`` scores before it on its flow.

    The last ``n`` scores of a flow are carried along in order of rank, so a row costs a search and two moves.
    """
    groups = OrderedGroups(scores, ["flow_key"], ["ts_us", "row_id"], hot_rows, parts)
    rows = groups.over_last(n, lambda w: {}, keep_chunks=True)

    def step(state, score):
        recent, ranked = state
        known = len(ranked)
        score = None if score is None or score != score else score  # nulls arrive as not-a-number
        at_least = 0 if score is None else known - bisect_left(ranked, score)
        recent.append(score)
        if score is not None:
            insort(ranked, score)
        if len(recent) > n and (old := recent.popleft()) is not None:
            del ranked[bisect_left(ranked, old)]
        return state, ((at_least + 1) / (known + 1), known)

    out = fold_rows(rows.withColumn("score", F.col("score").cast("double")), ["flow_key", "_chunk"], ["ts_us", "row_id"], ["score"],
                    lambda: (deque(), []), step, "p_value double, calibration_size int")
    out = out.filter("_own").drop("_own", "_chunk", "_rn")
    return out.withColumn("is_anomaly", F.col("p_value") <= epsilon)


def flag_replays(envelopes, max_skew_us: int = 30 * SECOND, hot_rows=None, parts=None) -> DataFrame:
    """Accept an envelope when it is fresh and its number is above every accepted one.

    Accepted numbers are the record highs among fresh envelopes, so the highest fresh number
    so far stands in for the highest accepted one.
    """
    fresh = F.abs(F.col("recv_ts_us") - F.col("sent_ts_us")) <= max_skew_us
    groups = OrderedGroups(envelopes, ["sender_id"], ["recv_ts_us", "env_id"], hot_rows, parts)
    run = groups.running(_high=Running("max", F.when(fresh, F.col("seq")), inclusive=False)).df
    high = F.greatest(F.coalesce("_high", F.lit(0)), F.lit(0))
    verdict = F.when(F.col("seq") <= high, "REPLAY").when(~fresh, "STALE").otherwise("ACCEPTED")
    return run.withColumns({"last_seq": high, "verdict": verdict}).drop("_high")


def inter_arrival(df, keys, ts="ts_us", seq="pkt_id", hot_rows=None, parts=None) -> DataFrame:
    """Seconds since the previous row of the key, null on its first."""
    seen = OrderedGroups(df, keys, [ts, seq], hot_rows, parts).previous(_before=F.col(ts)).df
    return seen.withColumn("iat", (F.col(ts) - F.col("_before")) / SECOND).drop("_before")


def recent_log(df, n: int, ts="ts_us", seq="seq") -> DataFrame:
    """The last ``n`` records, newest first."""
    return df.orderBy(F.desc(ts), F.desc(seq)).limit(n)


def verify_audit_chain(log, genesis: str, hot_rows=None, parts=None) -> DataFrame:
    """Recompute every link and seal from the stored hash before it; all check in parallel.

    One row per segment. ``gaps`` counts rows and segments that do not follow their predecessor; ``complete`` says
    whether the log ends with a closing row that has its numbers of segments and rows."""
    start = F.sha2(F.lit(genesis), 256)
    per = log.groupBy("log_id", "segment").agg(F.max("seq").alias("_last"), F.max_by("hash", "seq").alias("_seal"), F.max_by("payload", "seq").alias("_text"),
                                               F.count(F.lit(1)).alias("_n"))
    by_log = Window.partitionBy("log_id")
    before = by_log.orderBy("segment")
    closing = F.col("segment") == F.max("segment").over(by_log)
    per = per.withColumns({"_seal_before": F.coalesce(F.lag("_seal").over(before), start), "_follows": F.col("segment") == F.coalesce(F.lag("segment").over(before) + 1, F.lit(0)),
                           "_closing": closing, "_segments": F.count(F.lit(1)).over(by_log) - 1, "_rows": F.sum(F.when(closing, 0).otherwise(F.col("_n") - 1)).over(by_log)})
    total = F.concat_ws("|", F.lit("LOG_CLOSED"), F.col("_segments").cast("string"), F.col("_rows").cast("string"))
    per = per.withColumn("complete", F.max(F.col("_closing") & (F.col("_text") == total)).over(by_log)).drop("_text", "_n", "_segments", "_rows", "_seal")
    groups = OrderedGroups(log, ["log_id", "segment"], ["seq"], hot_rows, parts)
    linked = groups.previous(_prev=F.col("hash"), _seq=F.col("seq")).df.join(per, ["log_id", "segment"])
    tail = F.coalesce("_prev", start)
    text = (F.when(F.col("_closing"), F.concat("_seal_before", "payload")).when(F.col("seq") == F.col("_last"), F.concat("_seal_before", tail, "payload"))
            .otherwise(F.concat(tail, "payload")))
    good = F.col("hash") == F.sha2(text, 256)
    dense = (F.col("seq") == F.coalesce(F.col("_seq") + 1, F.lit(1))) & (F.col("_follows") | (F.col("seq") > 1))
    return linked.groupBy("log_id", "segment").agg(
        F.count(F.lit(1)).alias("links"), F.sum((~good).cast("int")).alias("broken_links"),
        F.sum((~dense).cast("int")).alias("gaps"), F.first("complete").alias("complete"),
        (F.bool_and(good & dense) & F.first("complete")).alias("intact"))
