"""Order-dependent operators that survive hot keys.

Rows of a group in time order are the base of most traffic operators (gaps, running counts,
sliding windows, streaks). A plain window puts a whole group into one task, which is right
while groups are small. ``OrderedGroups`` checks the largest group first: beyond ``hot_rows``
rows it range-partitions by (keys, order) instead, so that a hot group is cut into balanced
runs, works inside the runs, and adds what the earlier runs of the group contribute. Only
groups that cross a run boundary need such a carry, so the carry table has at most two rows
per partition and is safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import durable

HOT_ROWS = 2_000_000
CHUNK_ROWS = 100_000
STRETCH = 16
_PART, _CHUNK, _OWN = "_part", "_chunk", "_own"


@dataclass(frozen=True)
class Running:
    """A prefix aggregate: ``how`` is sum, max or last (last non-null value)."""

    how: str
    value: Column
    inclusive: bool = True

    def over(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        if self.how == "sum":
            return F.sum(self.value).over(frame)
        if self.how == "max":
            return F.max(self.value).over(frame)
        return F.last(self.value, ignorenulls=True).over(frame)

    def of_run(self, order: Column) -> Column:
        if self.how == "sum":
            return F.sum(self.value)
        if self.how == "max":
            return F.max(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def of_earlier_runs(self, column: Column, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        if self.how == "sum":
            return F.sum(column).over(frame)
        if self.how == "max":
            return F.max(column).over(frame)
        return F.last(column, ignorenulls=True).over(frame)

    def joined(self, local: Column, carry: Column | None) -> Column:
        if self.how == "sum":
            local = F.coalesce(local, F.lit(0))
            return local if carry is None else local + F.coalesce(carry, F.lit(0))
        if carry is None:
            return local
        return F.greatest(local, carry) if self.how == "max" else F.coalesce(local, carry)


def has_group_over(df: DataFrame, keys: list[str], limit: int) -> bool:
    """True when some group of ``keys`` has more than ``limit`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > limit).isEmpty()


def needs_split(df: DataFrame, keys: list[str], hot_rows: int | bool | None) -> bool:
    """Whether to cut groups. ``hot_rows`` is the limit per group (None: the default); True or
    False is an answer the caller already has, e.g. from a coarser key."""
    if isinstance(hot_rows, bool):
        return hot_rows
    return has_group_over(df, keys, HOT_ROWS if hot_rows is None else hot_rows)


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and totally ordered by the columns ``order``."""

    def __init__(self, df, keys, order, hot_rows=None, parts=None):
        self.keys, self.order = list(keys), list(order)
        self.split = needs_split(df, self.keys, hot_rows)
        if self.split:
            by = [F.col(c) for c in self.keys + self.order]
            ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
            df = durable(ranged.withColumn(_PART, F.spark_partition_id()))
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_PART)

    def _with(self, df: DataFrame) -> OrderedGroups:
        other = object.__new__(OrderedGroups)
        other.keys, other.order, other.split, other._df = self.keys, self.order, self.split, df
        return other

    def derive(self, fn) -> OrderedGroups:
        """Apply a row-wise ``fn(DataFrame) -> DataFrame`` without leaving the ordering."""
        return self._with(fn(self._df))

    def _window(self):
        runs = [_PART] if self.split else []
        return Window.partitionBy(*self.keys, *runs).orderBy(*self.order)

    def _join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        names = {k: f"_k{i}" for i, k in enumerate(self.keys + [_PART])}
        carry = carry.withColumnsRenamed(names)
        same = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
        on = reduce(lambda a, b: a & b, same)
        return df.join(F.broadcast(carry), on, "left").drop(*names.values())

    def _runs(self, aggregates: dict[str, Column]) -> DataFrame:
        """One row per run of the groups that cross a run boundary."""
        runs = self._df.groupBy(*self.keys, _PART).agg(*[c.alias(n) for n, c in aggregates.items()])
        crossing = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
        return runs.withColumn("_runs", crossing).filter("_runs > 1").drop("_runs")

    def running(self, **specs: Running) -> OrderedGroups:
        """Add one prefix aggregate per keyword."""
        window = self._window()
        if not self.split:
            return self._with(self._df.withColumns(
                {n: s.joined(s.over(window), None) for n, s in specs.items()}))
        row = F.struct(*self.order)
        runs = self._runs({f"_c_{n}": s.of_run(row) for n, s in specs.items()})
        earlier = Window.partitionBy(*self.keys).orderBy(_PART)
        carry = runs.select(*self.keys, _PART, *[
            s.of_earlier_runs(F.col(f"_c_{n}"), earlier).alias(f"_c_{n}") for n, s in specs.items()])
        local = self._df.withColumns({f"_l_{n}": s.over(window) for n, s in specs.items()})
        out = self._join_carry(local, carry)
        out = out.withColumns(
            {n: s.joined(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, s in specs.items()})
        return self._with(out.drop(*[f"_l_{n}" for n in specs], *[f"_c_{n}" for n in specs]))

    def _neighbour(self, values: dict[str, Column], step, edge) -> OrderedGroups:
        window = self._window()
        box = F.struct(*[c.alias(n) for n, c in values.items()])
        if not self.split:
            out = self._df.withColumn("_box", step(box).over(window))
        else:
            runs = self._runs({"_edge": edge(box, F.struct(*self.order))})
            across = Window.partitionBy(*self.keys).orderBy(_PART)
            carry = runs.select(*self.keys, _PART, step(F.col("_edge")).over(across).alias("_edge"))
            local = self._df.withColumn("_local", step(box).over(window))
            out = self._join_carry(local, carry)
            out = out.withColumn("_box", F.coalesce("_local", "_edge")).drop("_local", "_edge")
        return self._with(out.withColumns({n: F.col(f"_box.{n}") for n in values}).drop("_box"))

    def previous(self, **values: Column) -> OrderedGroups:
        """Values of the row before, null on the first row of a group."""
        return self._neighbour(values, F.lag, F.max_by)

    def following(self, **values: Column) -> OrderedGroups:
        """Values of the row after, null on the last row of a group."""
        return self._neighbour(values, F.lead, F.min_by)

    def numbered(self, name: str = "rn") -> OrderedGroups:
        """Position of each row in its group, from 1."""
        return self.running(**{name: Running("sum", F.lit(1).cast("bigint"))})

    def over_last(self, n: int, compute, chunk_rows: int | None = None, prepare=None,
                  keep_chunks: bool = False) -> DataFrame:
        """``compute(window)`` gives columns whose frames reach at most ``n`` rows back.
        ``prepare(window)`` may add columns over the whole partition for ``compute`` to use.
        ``keep_chunks`` returns all chunk rows with ``_rn``, ``_chunk`` and ``_own``.

        Hot groups are cut into chunks of a fixed row count; each chunk also gets the last
        ``n`` rows of the chunk before it, so that every frame is complete.
        """
        if not self.split:
            window = Window.partitionBy(*self.keys).orderBy(*self.order)
            df = self._df.withColumns(prepare(window)) if prepare else self._df
            df = df.withColumns(compute(window))
            return df.withColumns({"_rn": F.row_number().over(window).cast("bigint"), _CHUNK: F.lit(0).cast("bigint"),
                                   _OWN: F.lit(True)}) if keep_chunks else df
        size = max(chunk_rows or CHUNK_ROWS, n)
        pos = F.col("_rn") - 1
        chunk = F.floor(pos / size)
        needed = F.when(pos % size >= size - n, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
        df = self.numbered("_rn").df.withColumn(_CHUNK, F.explode(needed))
        df = df.withColumn(_OWN, F.col(_CHUNK) == chunk)
        window = Window.partitionBy(*self.keys, _CHUNK).orderBy(*self.order)
        df = df.withColumns(prepare(window)) if prepare else df
        df = df.withColumns(compute(window))
        return df if keep_chunks else df.filter(_OWN).drop("_rn", _CHUNK, _OWN)


def _plain_sums(df, keys, ts, seq, width, sums) -> DataFrame:
    rows = Window.partitionBy(*keys).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    gone = Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -width)
    return df.withColumns({
        n: F.sum(c).over(rows) - F.coalesce(F.sum(c).over(gone), F.lit(0)) for n, c in sums.items()})


def sliding_sums(df, keys, ts, seq, width, sums, hot_rows=None, parts=None) -> DataFrame:
    """Per row, sums over the rows of its group in ``(ts - width, ts]`` up to the row itself;
    rows of equal time count in the order of ``seq``. ``(keys, ts, seq)`` must be unique."""
    if not needs_split(df, keys, hot_rows):
        return _plain_sums(df, keys, ts, seq, width, sums)
    # a row needs no more than ``width`` of time before it, so a hot key is taken in stretches of time, each with the end of
    # the one before: one shuffle of the rows. Only a stretch that is hot itself has to be cut.
    length, at = STRETCH * width, F.col(ts)
    chunk = F.floor(at / length)
    limit = HOT_ROWS if hot_rows is None or isinstance(hot_rows, bool) else hot_rows
    if not has_group_over(df.select(*keys, chunk.alias(_CHUNK)), [*keys, _CHUNK], limit):
        needed = F.when(at - chunk * length >= length - width, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
        rows = df.withColumn(_CHUNK, F.explode(needed)).withColumn(_OWN, F.col(_CHUNK).eqNullSafe(chunk))
        return _plain_sums(rows, [*keys, _CHUNK], ts, seq, width, sums).filter(_OWN).drop(_CHUNK, _OWN)
    payload = F.struct(*[c for c in df.columns if c not in keys])

    def point(at, probe, row, values):
        return F.struct(at.alias("_t"), F.lit(probe).alias("_probe"), row.alias("_row"),
                        *[v.cast("double").alias(f"_v_{n}") if floating[n] else v.cast("bigint").alias(f"_v_{n}")
                          for n, v in values.items()])

    kinds = df.select(*[c.alias(n) for n, c in sums.items()]).schema
    floating = {f.name: f.dataType.typeName() in ("double", "float") for f in kinds.fields}
    points = F.array(
        point(F.col(ts), 0, payload, sums),
        point(F.col(ts) - width, 1, F.lit(None).cast(df.select(payload).schema[0].dataType), {n: F.lit(0) for n in sums}))
    both = df.select(*keys, F.col(seq).alias("_s"), F.col(ts).alias("_at"), F.explode(points).alias("_p"))
    both = both.select(*keys, "_s", "_at", "_p.*")
    run = OrderedGroups(both, keys, ["_t", "_probe", "_s"], True, parts).running(
        **{f"_p_{n}": Running("sum", F.col(f"_v_{n}")) for n in sums}).df
    sign = F.when(F.col("_probe") == 0, 1).otherwise(-1)
    out = run.groupBy(*keys, "_at", "_s").agg(
        F.max("_row").alias("_row"), *[F.sum(F.col(f"_p_{n}") * sign).alias(n) for n in sums])
    return out.select(*keys, "_row.*", *sums).select(*df.columns, *sums)


def sliding_distinct(df, keys, ts, seq, value, width, name, hot_rows=None, parts=None) -> DataFrame:
    """Per row, distinct ``value`` in the group's rows of ``(ts - width, ts]`` up to the row.

    A value adds one when it was not seen in the last ``width`` and takes one away when it
    runs out, so the count is a running sum and no row ever holds a set.
    """
    split = needs_split(df, keys, hot_rows)  # a hot (key, value) needs a hot key
    seen = OrderedGroups(df, [*keys, value], [ts, seq], split, parts)
    seen = seen.previous(_prev=F.col(ts)).following(_next=F.col(ts)).df
    fresh = F.when(F.col("_prev").isNull() | (F.col("_prev") <= F.col(ts) - width), 1).otherwise(0)
    last = F.col("_next").isNull() | (F.col("_next") >= F.col(ts) + width)
    payload = F.struct(*[c for c in df.columns if c not in keys])
    arrival = F.struct(F.col(ts).alias("_t"), F.lit(1).alias("_arrival"), fresh.alias("_d"), payload.alias("_row"))
    expiry = F.struct((F.col(ts) + width).alias("_t"), F.lit(0).alias("_arrival"), F.lit(-1).alias("_d"),
                      F.lit(None).cast(df.select(payload).schema[0].dataType).alias("_row"))
    points = F.when(last, F.array(arrival, expiry)).otherwise(F.array(arrival))
    both = seen.select(*keys, F.col(seq).alias("_s"), F.explode(points).alias("_p")).select(*keys, "_s", "_p.*")
    run = OrderedGroups(both, keys, ["_t", "_arrival", "_s"], split, parts)
    out = run.running(**{name: Running("sum", F.col("_d"))}).df
    return out.filter("_arrival = 1").select(*keys, "_row.*", name).select(*df.columns, name)


def ranked_values(df, value, keys=(), hot_rows=None, parts=None) -> DataFrame:
    """Distinct values in order with ``n``, ``upto`` (rows at or below) and ``total``."""
    keys = list(keys)
    if not keys:
        ranked = ranked_values(df.withColumn("_all", F.lit(0)), value, ["_all"], hot_rows, parts)
        return ranked.drop("_all")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    run = OrderedGroups(counts, keys, [value], hot_rows, parts).running(
        upto=Running("sum", F.col("n"))).df
    return run.join(totals, keys)


def order_statistics(df, value, picks, keys=(), extra=None, hot_rows=None, parts=None) -> DataFrame:
    """Exact picks from the sorted values. ``picks`` maps a name to ``total -> position``
    (from 0, fractions interpolate linearly between neighbours); ``extra`` holds further
    aggregates over the distinct values and their counts ``n``."""
    keys = list(keys)
    ranked = ranked_values(df, value, keys, hot_rows, parts)
    v, lo, hi = F.col(value), F.col("upto") - F.col("n"), F.col("upto") - 1
    aggs = []
    for name, position in picks.items():
        p = position(F.col("total"))
        below, above = F.floor(p), F.ceil(p)
        aggs += [F.max(F.when((lo <= below) & (below <= hi), v)).alias(f"_a_{name}"),
                 F.max(F.when((lo <= above) & (above <= hi), v)).alias(f"_b_{name}"),
                 F.max(p - below).alias(f"_f_{name}")]
    extra = extra or {}
    out = ranked.groupBy(*keys).agg(*aggs, *[c.alias(n) for n, c in extra.items()])
    return out.select(*keys, *extra, *[
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in picks])


def percentile_at(q: float):
    """Linear-interpolated percentile position, as numpy's default."""
    return lambda total: (total - 1) * F.lit(float(q))


def nearest_rank(q: float, at_least: int = 0):
    """Position ``int(total * q)``; the last one while there are not more than ``at_least`` rows."""
    return lambda total: F.when(total > at_least, F.floor(total * F.lit(float(q)))).otherwise(total - 1)
