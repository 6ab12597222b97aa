"""Order-dependent state: automata, smoothed baselines, drift tests, buckets and sessions.

Finite-state folds (connections, threat levels, consumed correlations) run on any key size: a
hot key is cut into runs, each run is summarised as a map from entry state to exit state, the
maps are chained over the few runs of that key, and the runs replay from their entry state.
Folds over real-valued state (``runs``) cut a hot key in the same way: their runs are put together by transfer maps,
by speculation or by pointer doubling.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import scalars as S
from packetloom.operators.joins import alert_arrivals, matched, within
from packetloom.operators.ordered import _PART, OrderedGroups, Running, ranked_values
from packetloom.operators.runs import (
    ClampedSmoothing, SmoothedMoments, TokenUnits, fold_rows, fold_runs, kept_at_intervals, sorted_by_group, with_fields)

SECOND = 1_000_000


# ---- finite automata --------------------------------------------------------------------------

def _replay(table):
    """Walk sorted rows; each group starts from the ``_entry`` of its first row."""
    rows = [list(map(int, r)) for r in table]

    def walk(batches):
        group, state = None, 0
        for pdf in batches:
            groups, symbols, entries = pdf["_g"].tolist(), pdf["_symbol"].tolist(), pdf["_entry"].tolist()
            before, after = [0] * len(groups), [0] * len(groups)
            for i, g in enumerate(groups):
                if g != group:
                    group, state = g, entries[i]
                before[i] = state
                state = after[i] = rows[symbols[i]][state]
            yield pdf.assign(state_before=np.array(before, "int32"), state_after=np.array(after, "int32"))

    return walk


def _summarise(table, columns):
    """Exit state of every group for every entry state."""
    table = np.asarray(table)

    def walk(batches):
        group, keep, exits = None, None, None
        for pdf in batches:
            out = []
            for g, part in pdf.groupby("_g", sort=False):
                if g != group:
                    if group is not None:
                        out.append((*keep, exits.tolist()))
                    group, keep, exits = g, tuple(part[columns].iloc[0]), np.arange(table.shape[1])
                for symbol in part["_symbol"].to_numpy():
                    exits = table[symbol][exits]
            yield pd.DataFrame(out, columns=[*columns, "_exits"])
        if group is not None:
            yield pd.DataFrame([(*keep, exits.tolist())], columns=[*columns, "_exits"])

    return walk


def _chain(start):
    """Entry state of each run of a group from the exits of the runs before it."""
    def walk(batches):
        group, state = None, start
        for pdf in batches:
            entries = []
            for g, exits in zip(pdf["_g"], pdf["_exits"]):
                if g != group:
                    group, state = g, start
                entries.append(state)
                state = int(exits[state])
            yield pdf.drop(columns=["_exits"]).assign(_entry=np.array(entries, "int32"))

    return walk


def run_automaton(df, keys, order, symbol: Column, table, start: int = 0, hot_rows=None, parts=None) -> DataFrame:
    """Add ``state_before`` and ``state_after``; ``table[symbol][state]`` is the next state."""
    groups = OrderedGroups(df.withColumn("_symbol", symbol.cast("int")), keys, order, hot_rows, parts)
    rows, entry = groups._df, F.lit(start).cast("int")
    run_keys = list(keys)
    if groups.split:
        run_keys = [*keys, _PART]
        crossing = groups._runs({"_n": F.count(F.lit(1))}).drop("_n")
        part_of = groups._join_carry(rows, crossing.withColumn("_crosses", F.lit(True)))
        part_of = part_of.filter("_crosses").select(*run_keys, *order, "_symbol")
        maps = sorted_by_group(part_of, run_keys, order)
        kinds = {f.name: f.dataType.simpleString() for f in part_of.schema.fields}
        shape = ", ".join(f"`{k}` {kinds[k]}" for k in run_keys)
        maps = maps.mapInPandas(_summarise(table, run_keys), f"{shape}, _exits array<bigint>")
        chained = sorted_by_group(maps, keys, [_PART])  # a few rows per partition of df
        entries = chained.mapInPandas(_chain(start), f"{shape}, _g string, _entry int").drop("_g")
        rows = groups._join_carry(rows, entries)
        entry = F.coalesce("_entry", entry)
    rows = sorted_by_group(rows.withColumn("_entry", entry), run_keys, order)
    out = rows.mapInPandas(_replay(table), with_fields(rows, "state_before int, state_after int"))
    return out.drop("_g", "_entry", "_symbol", _PART)


# ---- TCP connections --------------------------------------------------------------------------

CONNECTION_STATES = ["NONE", "NEW", "SYN_SENT", "SYN_RECEIVED", "ESTABLISHED", "FIN_WAIT", "CLOSED", "RESET"]
_NONE, _NEW, _SENT, _RECEIVED, _OPEN, _WAIT, _CLOSED, _RESET = range(8)


def _connection_table():
    """Rows: reset, SYN, SYN-ACK, FIN+ACK, ACK, FIN, other; then the same after a long pause."""
    def after(symbol, state):
        state = _NEW if state in (_NONE, _CLOSED, _RESET) else state
        if symbol == 0:
            return _RESET
        if symbol in (1, 2):
            return _SENT if symbol == 1 else _RECEIVED
        if symbol in (3, 4) and state == _RECEIVED:
            return _OPEN
        if symbol in (3, 5):
            return _CLOSED if state == _WAIT else _WAIT
        return state

    plain = [[after(s, q) for q in range(8)] for s in range(7)]
    paused = [[after(s, _NONE)] * 8 for s in range(7)]
    return plain + paused


def tcp_connections(packets, idle_us: int = 300 * SECOND, hot_rows=None, parts=None) -> DataFrame:
    """One row per connection: state, span, packets, bytes each way, last SNI and JA3.

    A reset or second FIN completes a connection and the next packet opens a new one; so does
    a pause of more than ``idle_us``, which leaves the old one CLOSED.
    """
    ends = S.conversation()
    flags = F.col("tcp_flags")
    extras = [c if c in packets.columns else F.lit(None).cast("string").alias(c) for c in ("sni", "ja3")]
    p = packets.filter("protocol = 'TCP'").select(
        *[c.alias(n) for n, c in ends.items()], "ts_us", "pkt_id", "size", "tcp_flags",
        "src_ip", "src_port", "dst_ip", "dst_port", *extras)
    keys, order = list(ends), ["ts_us", "pkt_id"]
    kind = (F.when(S.has(flags, 4), 0).when(S.is_syn(flags), 1).when(S.is_syn_ack(flags), 2)
            .when(S.has(flags, 16) & S.has(flags, 1), 3).when(S.has(flags, 16), 4)
            .when(S.has(flags, 1), 5).otherwise(6))
    groups = OrderedGroups(p, keys, order, hot_rows, parts)
    gap = groups.previous(_before=F.col("ts_us")).df
    paused = F.coalesce(F.col("ts_us") - F.col("_before") > idle_us, F.lit(False))
    gap = gap.withColumn("_paused", paused)
    run = run_automaton(gap, keys, order, kind + F.when(F.col("_paused"), 7).otherwise(0), _connection_table(),
                        hot_rows=groups.split, parts=parts)
    opens = (F.col("_paused") | F.col("state_before").isin(_NONE, _CLOSED, _RESET)).cast("int")
    run = OrderedGroups(run, keys, order, groups.split, parts).running(connection=Running("sum", opens)).df
    when, last = F.struct("ts_us", "pkt_id"), F.struct("ts_us", "pkt_id")
    c = run.groupBy(*keys, "connection").agg(
        F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port"), when).alias("_first"),
        F.max_by("state_after", last).alias("_state"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_seen_us"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.when((F.col("src_ip") == F.col("ip_low")) & (F.col("src_port") == F.col("port_low")), F.col("size")).otherwise(0)).alias("_up"),
        F.sum("size").alias("_all"),
        F.max_by("sni", F.when(F.col("sni").isNotNull(), last)).alias("sni"),
        F.max_by("ja3", F.when(F.col("ja3").isNotNull(), last)).alias("ja3"))
    c = c.withColumn("_newest", F.max("connection").over(Window.partitionBy(*keys)))
    names = F.array(*[F.lit(n) for n in CONNECTION_STATES])
    state = F.element_at(names, F.col("_state") + 1)
    left_open = (F.col("connection") < F.col("_newest")) & ~F.col("_state").isin(_CLOSED, _RESET)
    low_first = (F.col("_first.src_ip") == F.col("ip_low")) & (F.col("_first.src_port") == F.col("port_low"))
    sent = F.when(low_first, F.col("_up")).otherwise(F.col("_all") - F.col("_up"))
    return c.select(
        "_first.*", "connection", F.when(left_open, "CLOSED").otherwise(state).alias("state"), "start_us", "last_seen_us",
        "packets", sent.alias("bytes_sent"), (F.col("_all") - sent).alias("bytes_recv"), "sni", "ja3")


ACTIVE_STATES = ("NEW", "SYN_SENT", "SYN_RECEIVED", "ESTABLISHED")


def flow_state_counts(connections: DataFrame) -> DataFrame:
    return connections.groupBy("state").agg(F.count(F.lit(1)).alias("connections"))


def active_flows(connections: DataFrame, n: int = 50) -> DataFrame:
    live = connections.filter(F.col("state").isin(*ACTIVE_STATES))
    return live.orderBy(F.desc("last_seen_us"), "src_ip", "src_port", "dst_ip", "dst_port").limit(n)


# ---- threat levels ----------------------------------------------------------------------------

LEVELS = ["BASELINE", "WATCH", "SUSPECT", "HOSTILE"]
LEVEL_WINDOW_S = [30, 15, 10, 5]  # fixed values
_FORCE = 5


def _level_table():
    """State: level, normal streak up to 3, elevated streak up to 2. Rows: score below .25,
    below .35, below .55, below .75, from .75 up, and a correlated alert."""
    def code(level, normal, elevated):
        return (level * 4 + min(normal, 3)) * 3 + min(elevated, 2)

    def after(symbol, level, normal, elevated):
        if symbol == _FORCE:
            return code(3, 0, 0) if level < 3 else code(level, normal, elevated)
        normal = normal + 1 if symbol == 0 else 0
        elevated = elevated + 1 if symbol >= 2 else 0
        up = level
        if normal >= 3 and level > 0:
            up = 0
        elif level == 0 and symbol >= 2:
            up = 1
        elif level == 1 and (symbol >= 3 or elevated >= 2):
            up = 2
        elif level == 2 and symbol >= 4:
            up = 3
        return code(up, 0, 0) if up != level else code(level, normal, elevated)

    return [[after(s, q // 12, q // 3 % 4, q % 3) for q in range(48)] for s in range(6)]


def threat_levels(scores, forced=None, hot_rows=None, parts=None) -> DataFrame:
    """Threat level of each flow before and after every scored window.

    ``forced`` (flow_key, ts_us, row_id) holds correlated alerts, which raise a flow to HOSTILE.
    """
    s = F.col("score")
    rows = scores.select("flow_key", "ts_us", "row_id", s.cast("double").alias("score"), F.lit(0).alias("forced"))
    if forced is not None:
        rows = rows.unionByName(forced.select("flow_key", "ts_us", "row_id", F.lit(None).cast("double").alias("score"),
                                              F.lit(1).alias("forced")))
    symbol = (F.when(F.col("forced") == 1, _FORCE).when(s < 0.25, 0).when(s < 0.35, 1).when(s < 0.55, 2)
              .when(s < 0.75, 3).otherwise(4))
    run = run_automaton(rows, ["flow_key"], ["ts_us", "forced", "row_id"], symbol, _level_table(), 0, hot_rows, parts)
    names, seconds = F.array(*[F.lit(n) for n in LEVELS]), F.array(*[F.lit(n) for n in LEVEL_WINDOW_S])
    was, now = F.floor(F.col("state_before") / 12).cast("int") + 1, F.floor(F.col("state_after") / 12).cast("int") + 1
    return run.select("flow_key", "ts_us", "row_id", "score", "forced", F.element_at(names, was).alias("from_level"),
                      F.element_at(names, now).alias("to_level"), F.element_at(seconds, now).alias("window_s"))


def transitions(levels: DataFrame) -> DataFrame:
    score = F.col("score")
    reason = (F.when(F.col("forced") == 1, "correlated alert").when(F.col("to_level") == "BASELINE", "three normal windows")
              .when((F.col("to_level") == "SUSPECT") & (score < 0.55), "two elevated windows").otherwise("score over threshold"))
    return levels.filter("from_level <> to_level").withColumn("reason", reason)


def recent_transitions(levels: DataFrame, n: int = 20) -> DataFrame:
    return transitions(levels).orderBy(F.desc("ts_us"), F.desc("row_id"), F.desc("forced")).limit(n)


def threat_level_summary(levels: DataFrame) -> DataFrame:
    """Flows per current level."""
    last = levels.groupBy("flow_key").agg(F.max_by("to_level", F.struct("ts_us", "forced", "row_id")).alias("level"))
    return last.groupBy("level").agg(F.count(F.lit(1)).alias("flows"))


# ---- alerts: incidents, consumed correlations, cooldown ----------------------------------------

# fixed values: attack chains in matching order
CHAINS = [
    ("recon_to_exploit", ["PORT_SCAN", "BRUTE_FORCE"], "Ports were probed, then passwords tried"),
    ("scan_flood_tunnel", ["PORT_SCAN", "SYN_FLOOD", "DNS_TUNNEL"], "Probing, a flood and a DNS tunnel in turn"),
    ("recon_to_c2", ["PORT_SCAN", "DNS_TUNNEL"], "Ports were probed, then a DNS tunnel opened"),
    ("brute_to_exfil", ["BRUTE_FORCE", "DNS_EXFIL"], "Passwords were tried, then data left through DNS"),
    ("flood_tunnel", ["SYN_FLOOD", "ICMP_TUNNEL"], "A flood covers an ICMP tunnel"),
]


def chain_match(categories: Column, field: int) -> Column:
    """Name or description of the first chain whose stages are all among ``categories``."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for chain in CHAINS:
        stages = F.array(*[F.lit(s) for s in chain[1]])
        out = out.when(F.size(F.array_except(stages, categories)) == 0, chain[field])
    return out


def incidents(alerts, gap_us: int = 60 * SECOND, hot_rows=None, parts=None) -> DataFrame:
    """Sessions of alerts per source, joined while the gap is at most ``gap_us``."""
    a = alerts.withColumn("source_ip", F.coalesce("source_ip", F.lit("unknown")))
    groups = OrderedGroups(a, ["source_ip"], ["ts_us", "alert_id"], hot_rows, parts)
    groups = groups.previous(_before=F.col("ts_us"))
    fresh = F.when(F.col("ts_us") - F.col("_before") <= gap_us, 0).otherwise(1)
    groups = groups.running(session=Running("sum", fresh))
    at = F.struct("ts_us", "alert_id")
    # first per category, so that a session is never held as a list of its alerts
    per = groups.df.groupBy("source_ip", "session", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max("ts_us").alias("last_us"),
        F.max("severity").alias("worst"), F.min_by("severity", at).alias("opening"))
    s = per.groupBy("source_ip", "session").agg(
        F.sum("n").alias("alerts"), F.min("first_at.ts_us").alias("first_seen_us"), F.max("last_us").alias("last_seen_us"),
        F.max("worst").alias("_worst"), F.min_by("opening", "first_at").alias("_opening"),
        F.transform(F.array_sort(F.collect_list(F.struct("first_at", "category"))), lambda x: x["category"]).alias("categories"))
    n, worst = F.col("alerts"), F.col("_worst")
    chain = chain_match(F.col("categories"), 0)
    base = F.when(n >= 3, F.greatest(worst, F.lit(4))).when(n == 2, F.greatest(worst, F.lit(3))).otherwise(worst)
    s = s.withColumns({"attack_chain": chain, "chain_description": chain_match(F.col("categories"), 2)})
    s = s.withColumn("severity", F.when((n >= 2) & F.col("attack_chain").isNotNull(), 5).otherwise(base))
    return s.withColumns({
        "escalated": F.col("severity") > F.col("_opening"),
        "duration": (F.col("last_seen_us") - F.col("first_seen_us")) / SECOND}).drop("_worst", "_opening")


def incident_stats(found: DataFrame, now_us: int, gap_us: int = 60 * SECOND) -> DataFrame:
    live = F.col("last_seen_us") >= now_us - gap_us
    return found.agg(
        F.count(F.lit(1)).alias("total_incidents"), F.count(F.when(live, 1)).alias("active_incidents"),
        F.count(F.when(~live, 1)).alias("completed_incidents"), F.count(F.when(F.col("escalated"), 1)).alias("escalated"))


def incident_summary(found: DataFrame) -> DataFrame:
    from packetloom.functions.names import severity_label

    chain = F.when(F.col("chain_description").isNotNull(), F.concat(F.lit(" ["), "chain_description", F.lit("]"))).otherwise("")
    return found.withColumn("summary", F.format_string(
        "%d alerts from %s (%s)%s [%s]", "alerts", "source_ip", F.array_join("categories", ", "), chain,
        severity_label(F.col("severity"))))


def correlate_consume(rules, ml, window_us: int = 30 * SECOND, hot_rows=None, parts=None) -> DataFrame:
    """Like the interval join, but a match uses up what was pending on its flow."""
    def after(kind, near, state):
        pending = (0 if state == 4 else state) | (2 if kind else 1)
        return 4 if pending == 3 and near else pending

    table = [[after(kind, near, q) for q in range(5)] for kind in (0, 1) for near in (0, 1)]
    arrivals = alert_arrivals(rules, ml, hot_rows, parts)
    near = F.coalesce(within(window_us), F.lit(False)).cast("int")
    run = run_automaton(arrivals.df, ["flow_key"], ["ts_us", "kind", "seq"], F.col("kind") * 2 + near, table,
                        hot_rows=arrivals.split, parts=parts)
    return matched(run.filter("state_after = 4"))


# ---- real-valued folds --------------------------------------------------------------------------

def cooldown(alerts, keys, seconds: float, order=("ts_us", "seq"), hot_rows=None, parts=None) -> DataFrame:
    """Keep an alert only when the last kept one of its key is at least ``seconds`` older."""
    return kept_at_intervals(alerts, keys, order, int(seconds * SECOND), hot_rows, parts).filter("_keep").drop("_keep")


def ewma_step(alpha: float = 0.1, warmup: int = 20, against: str = "updated"):
    """``step(state, position, value) -> (state, (mean, std, z))``; state None opens a series."""
    def step(state, rn, x):
        n, mean, var, seen = state if state is not None else (rn - 1, None, 0.0, [])
        n += 1
        if n <= warmup:
            seen = [*seen, x]
            std = 0.0
            if n == warmup and len(seen) == warmup:
                mean = math.fsum(seen) / n
                var = math.fsum((v - mean) ** 2 for v in seen) / (n - 1) if n > 1 else 0.0
                std = math.sqrt(var)
            shown, base, scale = (mean if mean is not None else x), mean, std
        elif mean is None:
            mean, shown, base, scale = x, x, None, 0.0
        else:
            prior = (mean, math.sqrt(max(var, 0.0)))
            d = x - mean
            mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
            base, scale = (mean, math.sqrt(max(var, 0.0))) if against == "updated" else prior
            shown = mean
        z = (x - base) / scale if n >= warmup and base is not None and scale >= 1e-10 else None
        return (n, mean, var, seen if n < warmup else []), (shown, math.sqrt(max(var, 0.0)), z)

    return step


def ewma_zscore(series, alpha: float = 0.1, warmup: int = 20, against: str = "updated", hot_rows=None, parts=None) -> DataFrame:
    """Smoothed mean and deviation of (metric, ts_us, value), and the z-score of each value.

    The first ``warmup`` values set the baseline. ``against='prior'`` compares with the
    baseline before the value was absorbed. A long series is cut into runs, whose effect on mean and
    variance is an affine map and a quadratic form; the runs are chained and replayed.
    """
    groups = OrderedGroups(series, ["metric"], ["ts_us"], hot_rows, parts).numbered("_rn")
    out = fold_runs(groups, ["metric"], ["ts_us"], ["_rn", "value"], lambda: None, ewma_step(alpha, warmup, against),
                    "mean double, std double, z double", SmoothedMoments(alpha, warmup))
    return out.drop("_rn")


def ewma_alerts(zscores, threshold: float = 3.0, cooldown_s: float = 10.0, hot_rows=None, parts=None) -> DataFrame:
    """Spikes and drops of at least ``threshold`` deviations, one per metric and cooldown."""
    z = F.col("z")
    hits = zscores.filter(z.isNotNull() & (F.abs(z) >= threshold))
    kept = cooldown(hits, ["metric"], cooldown_s, order=("ts_us",), hot_rows=hot_rows, parts=parts)
    return kept.withColumns({
        "severity": S.z_severity(z), "direction": F.when(z > 0, "spike").otherwise("drop"),
        "confidence": F.least(F.lit(1.0), F.abs(z) / 6.0)})


def ewma_baselines(zscores: DataFrame, warmup: int = 20) -> DataFrame:
    """Current baseline of every metric."""
    last = zscores.groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"), F.max_by(F.struct("mean", "std"), "ts_us").alias("b"))
    return last.select("metric", "samples", "b.mean", "b.std", (F.col("samples") >= warmup).alias("warmed_up"))


def page_hinkley(scores, keys=("detector",), delta=0.01, threshold=10.0, alpha=0.01, cooldown_s: float = 0.0,
                 order=("ts_us",), hot_rows=None, parts=None) -> DataFrame:
    """Gradual mean shift: alert when the summed deviation climbs ``threshold`` over its
    minimum, then start again. Inside the cooldown neither happens.

    The height over the minimum is all that is kept of the sum, so that runs of a cut key that start from a guess
    meet the true course at the next minimum or alert.
    """
    wait = int(cooldown_s * SECOND)

    def step(state, ts, x):
        mean, height, alerted = state
        if mean is None:
            return (x, 0.0, alerted), (0.0, False)
        mean = alpha * x + (1 - alpha) * mean
        height = max(0.0, height + (x - mean - delta))
        if height > threshold and (alerted is None or ts - alerted >= wait):
            return (None, 0.0, ts), (height, True)
        return (mean, height, alerted), (height, False)

    return fold_runs(scores, list(keys), list(order), [order[0], "score"], lambda: (None, 0.0, None), step,
                     "deviation double, drift boolean", None, hot_rows, parts)


def values_at(df, value: str, wanted, position: Column, name: str, hot_rows=None, parts=None) -> DataFrame:
    """Add the value at a (fractional, from 0) position of the sorted ``value`` column of ``df``
    to each row of ``wanted``; ``_n`` is available to ``position`` as the number of values."""
    ranked = ranked_values(df, value, (), hot_rows, parts)
    total = ranked.agg(F.max("total").alias("_n")).withColumn("_all", F.lit(0))
    w = wanted.withColumn("_all", F.lit(0)).join(F.broadcast(total), "_all").drop("_all")
    w = w.withColumns({"_p": position, "_id": F.monotonically_increasing_id()})
    probes = w.select("*", F.explode(F.array(F.floor("_p"), F.ceil("_p"))).alias("_at"), F.lit(1).alias("_kind"))
    points = ranked.select((F.col("upto") - F.col("n")).alias("_at"), F.lit(0).alias("_kind"),
                           F.lit(-1).cast("bigint").alias("_id"), F.col(value).alias("_v"))
    both = points.unionByName(probes, allowMissingColumns=True)
    found = OrderedGroups(both, [], ["_at", "_kind", "_id"], hot_rows, parts).running(
        _found=Running("last", F.col("_v"))).df.filter("_kind = 1")
    low, high = F.min("_found"), F.max("_found")
    part = F.max("_p") - F.floor(F.max("_p"))
    return found.groupBy(*wanted.columns, "_id").agg((low + (high - low) * part).alias(name)).drop("_id")


def adaptive_contamination(predictions, training, initial=0.1, alpha=0.15, low=0.01, high=0.3, window=100, every=50,
                           keys=("detector",), hot_rows=None, parts=None) -> DataFrame:
    """Contamination after every ``every`` predictions and the threshold it implies.

    ``predictions``: keys, ts_us, row_id, y; the recent rate is a window, and only the one row
    in ``every`` where an update happens is folded. ``training`` holds the ``score`` column the
    threshold is a percentile of.
    """
    keys = list(keys)
    groups = OrderedGroups(predictions, keys, ["ts_us", "row_id"], hot_rows, parts).numbered("n")
    rates = groups.over_last(window, lambda w: {"detection_rate": F.avg(F.col("y").cast("double")).over(w.rowsBetween(-(window - 1), 0))})
    updates = rates.filter(F.col("n") % every == 0).select(*keys, "n", "detection_rate")

    def step(c, rate):
        new = max(low, min(high, alpha * rate + (1 - alpha) * c))
        return new, (c, new)

    out = fold_runs(updates, keys, ["n"], ["detection_rate"], lambda: initial, step,
                    "old_contamination double, contamination double", ClampedSmoothing(alpha, low, high), groups.split, parts)
    return values_at(training, "score", out, (F.col("_n") - 1) * (1 - F.col("contamination")), "threshold", hot_rows, parts)


def dynamic_pvalue(streaks, confirm: int = 3, size: int = 1000, chunk_rows: int = 20_000, epsilon: float = 0.05,
                   hot_rows=None, parts=None) -> DataFrame:
    """p-value of each score against the last ``size`` confirmed normals of all flows.

    ``streaks`` comes from ``low_streak``; a row of streak ``confirm`` or more is a confirmed
    normal and joins the buffer after it was scored. Rows go in chunks, and each chunk first
    gets the buffer as it stood before its first row.
    """
    sure = F.col("streak") >= confirm
    groups = OrderedGroups(streaks, [], ["ts_us", "row_id"], hot_rows, parts).numbered("_rn")
    rows = groups.running(_c=Running("sum", sure.cast("int"), inclusive=False)).df
    rows = rows.withColumns({"_chunk": F.floor((F.col("_rn") - 1) / chunk_rows), "_sure": sure})
    heads = rows.groupBy("_chunk").agg(F.min("_c").alias("_c")).filter("_c > 0")
    need = heads.select("_chunk", F.explode(F.sequence(F.greatest(F.col("_c") - (size - 1), F.lit(1)), F.col("_c"))).alias("_i"))
    normals = rows.filter("_sure").select((F.col("_c") + 1).alias("_i"), "score")
    seeds = need.join(normals, "_i").select("_chunk", F.col("_i").alias("_rn"), "score", F.lit(True).alias("_seed"))
    seeds = seeds.withColumns({"_rn": F.col("_rn") - F.lit(1 << 62), "_sure": F.lit(True)})
    both = rows.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)

    def step(state, seed, sure_, score):
        from bisect import bisect_left, insort

        queue, ranked, head = state
        n = len(ranked)
        p = (n - bisect_left(ranked, score) + 1) / (n + 1) if n else 1.0
        if sure_:
            queue.append(score)
            insort(ranked, score)
            if len(ranked) > size:
                old = queue[head]
                del ranked[bisect_left(ranked, old)]
                head += 1
        return (queue, ranked, head), (p, n)

    out = fold_rows(both, ["_chunk"], ["_rn"], ["_seed", "_sure", "score"], lambda: ([], [], 0), step,
                    "p_value double, calibration_size bigint")
    out = out.filter("not _seed").drop("_seed", "_sure", "_chunk", "_rn", "_c")
    return out.withColumn("is_anomaly", (F.col("calibration_size") > 0) & (F.col("p_value") <= epsilon))


def bucket_step(rate: float = 10.0, burst: int = 20):
    """``step(state, ts) -> (state, (allowed, tokens))``; the first event leaves burst - 1."""
    return TokenUnits(rate, burst).step


def token_bucket(requests, keys, rate: float = 10.0, burst: int = 20, order=("ts_us", "seq"), hot_rows=None, parts=None) -> DataFrame:
    """Allow or deny each request, counted in whole units of a token (``TokenUnits``).

    A bucket of one token is empty after each allowed request, so there the allowed ones are those at intervals.
    """
    units = TokenUnits(rate, burst)
    if burst == 1:
        flagged = kept_at_intervals(requests, keys, order, -(-units.one // units.gain), hot_rows, parts)
        last = Running("last", F.when(F.col("_keep"), F.col(order[0])))
        run = OrderedGroups(flagged, keys, list(order), hot_rows, parts).running(_last=last).df
        filled = F.least(F.lit(1.0), (F.col(order[0]) - F.col("_last")) * F.lit(units.gain) / F.lit(units.one))
        return run.withColumns({"allowed": F.col("_keep"), "tokens": F.when(F.col("_keep"), 0.0).otherwise(filled)}).drop("_keep", "_last")
    return fold_runs(requests, keys, list(order), [order[0]], lambda: None, units.step, "allowed boolean, tokens double", units, hot_rows, parts)


# ---- liveness and eviction ----------------------------------------------------------------------

def node_liveness(heartbeats, now_us: Column, timeout_us: int = 15 * SECOND) -> DataFrame:
    """Last word of every sensor; OFFLINE after more than ``timeout_us`` of silence."""
    last = heartbeats.groupBy("node_id").agg(
        F.max("ts_us").alias("last_us"), F.max_by(F.struct("uptime", "packets_sent"), F.struct("ts_us", "packets_sent")).alias("b"))
    silent = now_us - F.col("last_us") > timeout_us
    return last.select("node_id", "last_us", "b.uptime", "b.packets_sent", F.when(silent, "OFFLINE").otherwise("ONLINE").alias("status"))


def evict_stale(df, ts: str, now_us: Column, ttl_s: float) -> DataFrame:
    """Rows not idle for longer than the time to live."""
    return df.filter(now_us - F.col(ts) <= int(ttl_s * SECOND))
