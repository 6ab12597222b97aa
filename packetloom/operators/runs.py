"""Folds over real-valued state on keys of any size.

A key's rows are cut by time into runs that fit one task. What a run does to the state it is entered with decides how the
runs are put together, so that every row sees the state that one long fold would have shown it:

* *Transfer maps* (``summary``): the map of a run is a small value that composes (affine maps and their quadratic
  forms, clamped shifts, piecewise shifts). One pass sums up each run, one task a key chains the few maps, one pass replays.
* *Speculation*: without such a map, all runs start from the opening state at once; a run whose predecessor left another
  state is replayed from it, until no entry state moves. States that forget or start anew settle in a few rounds;
  after round ``k`` the first ``k`` runs are final, so it always ends.
* *Successors* (``kept_at_intervals``): "the first row at least ``wait`` after the last kept one" is a graph on rows. Each run shortcuts
  its own part; the jumps between runs are followed by pointer doubling.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import _PART, OrderedGroups, Running
from packetloom.session import durable

SECOND = 1_000_000
#: A moment after all rows.
NEVER = 2**62


def group_key(keys: list[str]) -> Column:
    """One string per group, for comparing neighbours inside a sorted partition."""
    return F.concat_ws("\x1f", F.lit(""), *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])


def sorted_by_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    df = df.withColumn("_g", group_key(keys))
    return df.repartition("_g").sortWithinPartitions("_g", *order)


def with_fields(df: DataFrame, extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [extra])


def _shape(df: DataFrame, columns: list[str], extra: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [extra])


def _per_run(columns, names, inputs, open_, add, close):
    """Walk sorted rows; one output row a run: ``open_(row) -> acc``, ``add(acc, *inputs) -> acc``, ``close(acc) -> values``."""
    def walk(batches):
        group, kept, acc = None, None, None
        for pdf in batches:
            out = []
            fields = zip(pdf["_g"].tolist(), *[pdf[c].tolist() for c in inputs])
            for i, (g, *values) in enumerate(fields):
                if g != group:
                    if group is not None:
                        out.append((*kept, *close(acc)))
                    row = pdf.iloc[i]
                    group, kept, acc = g, tuple(row[c] for c in columns), open_(row)
                acc = add(acc, *values)
            yield pd.DataFrame(out, columns=[*columns, *names])
        if group is not None:
            yield pd.DataFrame([(*kept, *close(acc))], columns=[*columns, *names])

    return walk


def fold_rows(df, keys, order, inputs, start, step, outputs: str, entry: str | None = None) -> DataFrame:
    """Fold each group in order: ``step(state, *inputs) -> (state, outputs)``; ``start()`` opens a group, or the JSON state in the
    column ``entry`` of its first row. Groups stream through sorted partitions; nothing but the state is kept."""
    names = [o.split()[0] for o in outputs.split(", ")]
    rows = sorted_by_group(df, list(keys), list(order))

    def walk(batches):
        group, state = None, None
        for pdf in batches:
            out = []
            entries = pdf[entry].tolist() if entry else [None] * len(pdf)
            for g, e, *values in zip(pdf["_g"].tolist(), entries, *[pdf[c].tolist() for c in inputs]):
                if g != group:
                    group, state = g, start() if e is None else json.loads(e)
                state, result = step(state, *values)
                out.append(result)
            columns = list(zip(*out)) if out else [[] for _ in names]
            yield pdf.assign(**{n: list(c) for n, c in zip(names, columns)})

    return rows.mapInPandas(walk, with_fields(rows, outputs)).drop("_g")


def _crossing_rows(groups: OrderedGroups) -> DataFrame:
    crossing = groups._runs({"_n": F.count(F.lit(1))}).withColumn("_crosses", F.lit(True)).drop("_n")
    return groups._join_carry(groups._df, crossing).filter("_crosses").drop("_crosses")


def _mapped_entries(groups, inputs, start, summary) -> DataFrame:
    keys, run = groups.keys, [*groups.keys, _PART]
    rows = _crossing_rows(groups).select(*run, *dict.fromkeys([c for c in [*groups.order, *inputs] if c not in run]))
    maps = sorted_by_group(rows, run, groups.order).mapInPandas(
        _per_run(run, ["_map"], inputs, lambda row: summary.identity(), summary.then, lambda acc: (json.dumps(acc),)), _shape(rows, run, "_map string"))

    def chain(batches):
        group, state = None, None
        for pdf in batches:
            entries = []
            for g, acc in zip(pdf["_g"], pdf["_map"]):
                if g != group:
                    group, state = g, start()
                entries.append(json.dumps(state))
                state = summary.apply(json.loads(acc), state)
            yield pdf.drop(columns=["_map"]).assign(_entry=entries)

    chained = sorted_by_group(maps, keys, [_PART])  # a few rows per partition of the table
    return chained.mapInPandas(chain, _shape(maps, run, "_g string, _entry string")).drop("_g")


def close_enough(a, b) -> bool:
    """Equal states, up to a few units in the last place of their numbers."""
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(close_enough, a, b))
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return a == b or math.isclose(a, b, rel_tol=1e-14, abs_tol=1e-300)
    return a == b


def _settled_entries(groups, inputs, start, step) -> DataFrame:
    keys, run = groups.keys, [*groups.keys, _PART]
    rows = _crossing_rows(groups).select(*run, *dict.fromkeys([c for c in [*groups.order, *inputs] if c not in run]))
    rows = durable(rows)

    def exits(todo):
        """Exit states of the runs of ``todo``, from the states they are entered with."""
        part = groups._join_carry(rows, todo).filter("_entry is not null")
        return sorted_by_group(part, run, groups.order).mapInPandas(
            _per_run(run, ["_entry", "_exit"], inputs, lambda row: (row["_entry"], json.loads(row["_entry"])),
                     lambda acc, *values: (acc[0], step(acc[1], *values)[0]), lambda acc: (acc[0], json.dumps(acc[1]))),
            _shape(rows, run, "_entry string, _exit string"))

    def compare(batches):
        group, left = None, None
        for pdf in batches:
            entries, moved = [], []
            for g, entry, exit_ in zip(pdf["_g"], pdf["_entry"], pdf["_exit"]):
                if g != group:
                    group, left = g, entry
                moves = not close_enough(json.loads(entry), json.loads(left))
                entries.append(left if moves else entry)
                moved.append(moves)
                left = exit_
            yield pdf.assign(_entry=entries, _moved=moved)

    first = rows.select(*run).distinct().withColumn("_entry", F.lit(json.dumps(start())))
    known = durable(exits(first))
    while True:
        checked = sorted_by_group(known, keys, [_PART])
        checked = durable(checked.mapInPandas(compare, with_fields(checked, "_moved boolean")).drop("_g"))
        todo = checked.filter("_moved").select(*run, "_entry")
        if todo.isEmpty():
            return checked.select(*run, "_entry")
        known = durable(checked.filter("not _moved").drop("_moved").unionByName(exits(todo)))


def fold_runs(df, keys, order, inputs, start, step, outputs: str, summary=None, hot_rows=None, parts=None) -> DataFrame:
    """``fold_rows`` for keys of any size; ``summary`` has the transfer maps of ``step``, without one runs are speculated."""
    groups = df if isinstance(df, OrderedGroups) else OrderedGroups(df, keys, order, hot_rows, parts)
    if not groups.split:
        return fold_rows(groups.df, keys, order, inputs, start, step, outputs)
    entries = _mapped_entries(groups, inputs, start, summary) if summary else _settled_entries(groups, inputs, start, step)
    rows = groups._join_carry(groups._df, entries)
    return fold_rows(rows, [*keys, _PART], order, inputs, start, step, outputs, "_entry").drop("_entry", _PART)


# ---- transfer maps ------------------------------------------------------------------------------


class SmoothedMoments:
    """Runs of a smoothed mean and variance whose state is ``(n, mean, var, values of the warm-up)``.

    Entered with a mean ``delta`` above the run's first value, the run ends with mean ``b + a * delta`` and variance
    ``a * var + B * delta^2 + C * delta + D``: ``b`` and ``D`` are the run's own course, which forgets as the fold does.
    """

    def __init__(self, alpha: float, warmup: int):
        self.alpha, self.warmup = alpha, warmup

    def identity(self):
        return [[], 0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]

    def then(self, acc, rn, x):
        lead, n, first, a, b, big_b, c, d = acc
        if rn <= self.warmup:
            return [[*lead, x], *acc[1:]]
        if not n:
            first = b = x
        q, apart = 1 - self.alpha, x - b
        return [lead, n + 1, first, q * a, b + self.alpha * apart, q * (big_b + self.alpha * a * a), q * (c - 2 * self.alpha * a * apart),
                q * (d + self.alpha * apart * apart)]

    def apply(self, acc, state):
        lead, k, first, a, b, big_b, c, d = acc
        n, mean, var, seen = state if state is not None else (0, None, 0.0, [])
        for x in lead:
            n, seen = n + 1, [*seen, x]
            if n == self.warmup and len(seen) == n:
                mean = math.fsum(seen) / n
                var = math.fsum((v - mean) ** 2 for v in seen) / (n - 1) if n > 1 else 0.0
        if k:
            delta = 0.0 if mean is None else mean - first
            mean, var = b + a * delta, a * var + (big_b * delta + c) * delta + d
        n += k
        return [n, mean, var, seen if n < self.warmup else []]


class ClampedSmoothing:
    """Runs of ``c -> clip(alpha * x + (1 - alpha) * c, low, high)``: again a line between two bounds."""

    def __init__(self, alpha: float, low: float, high: float):
        self.alpha, self.low, self.high = alpha, low, high

    def identity(self):
        return [1.0, 0.0, -math.inf, math.inf]

    def then(self, acc, x):
        a, b, low, high = acc
        q, more = 1 - self.alpha, self.alpha * x

        def clip(v):
            return max(self.low, min(self.high, v))

        return [q * a, q * b + more, clip(q * low + more), clip(q * high + more)]

    def apply(self, acc, c):
        a, b, low, high = acc
        return max(low, min(high, a * c + b))


class TokenUnits:
    """A token bucket in whole units, so that sums are exact: one token is ``one`` units, a microsecond brings ``gain``."""

    def __init__(self, rate: float, burst: int):
        exact = Fraction(str(rate))
        self.gain, self.one = exact.numerator, SECOND * exact.denominator
        self.full = burst * self.one

    def step(self, state, ts):
        units = self.full if state is None else min(self.full, state[0] + (ts - state[1]) * self.gain)
        allowed = units >= self.one
        units -= self.one if allowed else 0
        return [units, ts], (allowed, units / self.one)

    # A run's map: pieces [from, slope, c] of the units at its first event: ``slope * units + c`` after its last one. Units move
    # by whole tokens and gains until the bucket is full, so there are about as many pieces as it holds tokens, two or more.

    def identity(self):
        return [None, None, [[0, 1, 0]]]

    def then(self, acc, ts):
        first, last, pieces = acc
        gained = 0 if last is None else (ts - last) * self.gain
        out = []
        for k, (low, slope, c) in enumerate(pieces):
            high = pieces[k + 1][0] if k + 1 < len(pieces) else self.full + 1
            if not slope:
                value = min(self.full, c + gained)
                parts = [(low, 0, value - self.one if value >= self.one else value)]
            else:
                c += gained
                brim, enough = max(low, self.full - c), max(low, self.one - c)
                parts = [(low, 1, c)] if low < min(enough, brim) else []
                if max(low, enough) < min(high, brim):
                    parts.append((max(low, enough), 1, c - self.one))
                if brim < high:
                    parts.append((brim, 0, self.full - self.one if self.full >= self.one else self.full))
            for part in parts:
                if part[0] < high and (not out or out[-1][1:] != list(part[1:])):
                    out.append(list(part))
        return [ts if first is None else first, ts, out]

    def apply(self, acc, state):
        first, last, pieces = acc
        units = self.full if state is None else min(self.full, state[0] + (first - state[1]) * self.gain)
        slope, c = [p[1:] for p in pieces if p[0] <= units][-1]
        return [slope * units + c, last]


# ---- rows at intervals ----------------------------------------------------------------------------


def _shortcuts(ts: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in time order: when each one, were it kept, would let a row after this run be kept. Rows that agree are one
    piece: its last time and that moment."""
    after = np.searchsorted(ts, ts + wait)
    last = np.where(after < len(ts), after, np.arange(len(ts)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    free = ts[last] + wait
    ends = np.r_[free[1:] != free[:-1], True]
    return ts[ends], free[ends]


def kept_at_intervals(df, keys, order, wait: int, hot_rows=None, parts=None) -> DataFrame:
    """All rows with ``_keep``: each kept row is at least ``wait`` after the last kept one of its key; the first row is kept.

    On cut keys, a run's rows fall into pieces that end in the same moment (``_shortcuts``); the piece of a later run that
    this moment leads to is found for all pieces by one ordered pass, and the pieces really met are marked by pointer doubling
    in as many rounds as the logarithm of the number of runs.
    """
    keys, order = list(keys), list(order)
    if wait <= 0:
        return df.withColumn("_keep", F.lit(True))
    groups = OrderedGroups(df, keys, order, hot_rows, parts)

    def step(free, ts):
        keep = free is None or ts >= free
        return (ts + wait if keep else free), (keep,)

    if not groups.split:
        return fold_rows(groups.df, keys, order, [order[0]], lambda: None, step, "_keep boolean")

    run = [*keys, _PART]
    rows = _crossing_rows(groups).select(*run, F.col(order[0]).cast("long").alias("_t"))

    def pieces(batches):
        group, kept, times = None, None, []

        def done():
            t, free = _shortcuts(np.concatenate(times), wait)
            return pd.DataFrame({**{c: [v] * len(t) for c, v in zip(run, kept)}, "_t": t, "_free": free})

        for pdf in batches:
            for g, part in pdf.groupby("_g", sort=False):
                if g != group:
                    if group is not None:
                        yield done()
                    group, kept, times = g, tuple(part[run].iloc[0]), []
                times.append(part["_t"].to_numpy())
        if group is not None:
            yield done()

    nodes = sorted_by_group(rows, run, ["_t"]).mapInPandas(pieces, _shape(rows, run, "_t bigint, _free bigint"))
    nodes = durable(nodes.select(group_key(keys).alias("_k"), F.col(_PART).alias("part"), F.col("_t").alias("t"), F.col("_free").alias("free")))
    # each piece's moment looks for the first piece that ends at or after it, in falling order of time and run
    there = F.struct("part", "t")
    none = F.lit(None).cast(nodes.select(there).schema[0].dataType)
    ends = nodes.select("_k", (-F.col("t")).alias("_at"), F.lit(0).alias("_asks"), "part", "t", there.alias("_piece"))
    asks = nodes.select("_k", (-F.col("free")).alias("_at"), F.lit(1).alias("_asks"), "part", "t", none.alias("_piece"))
    both = ends.unionByName(asks).withColumn("_back", -F.col("part"))
    found = OrderedGroups(both, ["_k"], ["_at", "_asks", "_back", "t"], True, parts).running(to=Running("last", F.col("_piece"))).df
    jumps = durable(found.filter("_asks = 1 and to is not null").select("_k", "part", "t", "to", (-F.col("_at")).alias("free")))
    same = ["_k", "part", "t"]
    met = durable(nodes.groupBy("_k").agg(F.min(F.struct("t", "part")).alias("m")).select("_k", "m.part", "m.t", F.lit(None).cast("bigint").alias("free")))
    while True:
        on = met.drop("free").join(jumps, same).select("_k", "to.part", "to.t", "free")
        on = durable(on.join(met.select(*same), same, "left_anti"))
        if on.isEmpty():
            break
        met = durable(met.unionByName(on))
        onward = jumps.select("_k", F.struct("part", "t").alias("to"), F.col("to").alias("_to"), F.col("free").alias("_free"))
        jumps = durable(jumps.drop("free").join(onward, ["_k", "to"]).select("_k", "part", "t", F.col("_to").alias("to"), F.col("_free").alias("free")))
    entries = met.select("_k", F.col("part").alias(_PART), F.coalesce(F.col("free").cast("string"), F.lit("null")).alias("_entry"))
    crossing = groups._runs({"_n": F.count(F.lit(1))}).withColumn("_k", group_key(keys)).join(entries, ["_k", _PART], "left")
    rows = groups._join_carry(groups._df, crossing.select(*run, "_entry", F.lit(True).alias("_crosses")))
    rows = rows.withColumn("_entry", F.when(F.col("_crosses") & F.col("_entry").isNull(), json.dumps(NEVER)).otherwise(F.col("_entry")))
    return fold_rows(rows.drop("_crosses"), run, order, [order[0]], lambda: None, step, "_keep boolean", "_entry").drop("_entry", _PART)
