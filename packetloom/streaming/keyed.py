"""Keyed state of a stream: rows wait for the watermark and are then folded in event-time order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000


def closes(us):
    """The watermark, in milliseconds, that closes the second of a row."""
    return (us // SECOND + 1) * 1000


def to_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


class OrderedFold(StatefulProcessor):
    """A fold of all keys of one bucket, a group of keys by their hash; each key has a state of its own.

    A call to the state store or a pandas frame costs as much as many rows, so neither is made for one row: rows that come together
    wait together, as one typed Arrow block in a list state, and leave in one frame a bucket. A single timer a bucket stands for the
    first second that is still open and the first key that falls silent or is forgotten, so memory holds the rows of one bucket
    within the delay.

    Kept of a key: how many rows it had, the time of the last one, and the fields of ``state``; all typed, in the state store.
    """

    def __init__(self, keys, carried, kinds, schema, inputs, names, step, order, state, pack, unpack, ttl_s, silence_s, silent):
        self.keys, self.carried, self.kinds, self.schema, self.inputs, self.names = keys, carried, kinds, schema, inputs, names
        self.step, self.order, self.state, self.pack, self.unpack = step, order, state, pack, unpack
        self.ttl_us, self.silence_us, self.silent = ttl_s * SECOND, None if silence_s is None else silence_s * SECOND, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first bigint, block binary")
        self.kept = handle.getMapState("kept", ", ".join(self.kinds[k] for k in self.keys), f"_rows bigint, _last_us bigint, {self.state}")
        self.timer = handle.getValueState("timer", "at bigint, quiet bigint")  # the timer that is set; when a key is next silent or forgotten

    def close(self) -> None:
        pass

    def _frame(self, columns: list[list], results: list[tuple], late: bool) -> pd.DataFrame:
        made = [list(c) for c in zip(*results)] if results else [[] for _ in self.names]
        columns = {n: pd.Series(c, dtype=object) for n, c in zip([*self.carried, *self.names], [*columns, *made])}
        return pd.DataFrame(columns | {"late": late})

    def _set(self, first: int | None, quiet: int | None, known: tuple) -> None:
        """Have the one timer stand for ``first``, when rows can be folded, and ``quiet``, both watermarks."""
        at = min((t for t in (first, quiet) if t is not None), default=None)
        if (at, quiet) == known:
            return
        if at != known[0]:
            if known[0] is not None:
                self.handle.deleteTimer(known[0])
            if at is not None:
                self.handle.registerTimer(at)
        self.timer.update((at, quiet))

    def _known(self) -> tuple:
        return tuple(self.timer.get()) if self.timer.exists() else (None, None)

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        blocks, first = [], None
        for pdf in rows:
            table = pa.Table.from_pandas(pdf[self.carried], schema=self.schema, preserve_index=False)
            if table["ts_us"].null_count:
                raise ValueError("a row without ts_us has no place in a fold by event time")
            ends = closes(table["ts_us"].to_numpy())
            late = ends <= watermark
            if late.any():
                columns = [c.to_pylist() for c in table.filter(pa.array(late)).columns]
                yield self._frame(columns, [(None,) * len(self.names)] * int(late.sum()), True)
                table, ends = table.filter(pa.array(~late)), ends[~late]
            if len(ends):
                blocks.append(table)
                first = int(ends.min()) if first is None else min(first, int(ends.min()))
        if blocks:
            self.waiting.appendList([(first, to_bytes(pa.concat_tables(blocks)))])
            known = self._known()
            if known[0] is None or first < known[0]:
                self._set(first, known[1], known)

    def _due(self, watermark: int):
        """The rows whose second is closed, by key and order, and when the first of the others closes."""
        due, later = [], []
        for first, block in self.waiting.get():
            if first > watermark:
                later.append((first, block))
                continue
            table = pa.ipc.open_stream(block).read_all()
            ends = closes(table["ts_us"].to_numpy())
            open_ = ends > watermark
            if open_.any():
                later.append((int(ends[open_].min()), to_bytes(table.filter(pa.array(open_)))))
                table = table.filter(pa.array(~open_))
            due.append(table)
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        first = min((f for f, _ in later), default=None)
        if not due:
            return None, first
        table = pa.concat_tables(due).append_column("_arrival", pa.array(np.arange(sum(map(len, due)))))
        by = [(c, "ascending") for c in dict.fromkeys([*self.keys, *self.order, "_arrival"])]
        return table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_start")), first

    def _load(self, key: tuple) -> tuple:
        found = self.kept.getValue(key)
        if found is None:
            return 0, None, None
        count, last, *fields = found
        return count, last, self.unpack(tuple(fields))

    def _quiet(self, last: int, waits: list[int]) -> list[int]:
        return [closes(last + w) for w in waits]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        if known[0] is None or known[0] > watermark:
            return
        due, first = self._due(watermark)
        quiet = known[1]
        waits = [w for w in (self.silence_us, self.ttl_us) if w is not None]
        if due is not None:
            columns = [due[c].to_pylist() for c in self.carried]
            of = dict(zip(self.carried, columns))
            given = list(zip(*[of["ts_us" if c == "_position" else c] for c in self.inputs]))
            position = self.inputs.index("_position") if "_position" in self.inputs else None
            step, ttl_us, results, now = self.step, self.ttl_us, [], None
            for own, ts, args in zip(zip(*[of[k] for k in self.keys]), of["ts_us"], given):
                if own != now:
                    if now is not None:
                        self.kept.updateValue(now, (count, last, *self.pack(folded)))
                        quiet = min([*self._quiet(last, waits), *([] if quiet is None else [quiet])])
                    now = own
                    count, last, folded = self._load(own)
                if last is not None and ts - last > ttl_us:
                    count, folded = 0, None
                count, last = count + 1, ts
                folded, result = step(folded, *(args if position is None else (*args[:position], count, *args[position + 1:])))
                results.append(tuple(result))
            self.kept.updateValue(now, (count, last, *self.pack(folded)))
            quiet = min([*self._quiet(last, waits), *([] if quiet is None else [quiet])])
            yield self._frame(columns, results, False)
        if quiet is not None and quiet <= watermark:
            told, quiet = [], None
            for own, (count, last, *fields) in list(self.kept.iterator()):
                ends = self._quiet(last, waits)
                if self.silence_us is not None and ends[0] <= watermark:  # no row until then can still come
                    folded, result = self.silent(self.unpack(tuple(fields)))
                    if result is not None:
                        told.append((own, tuple(result)))
                        self.kept.updateValue(own, (count, last, *self.pack(folded)))
                if ends[-1] <= watermark:
                    self.kept.removeKey(own)
                    continue
                open_ = [e for e in ends if e > watermark]
                quiet = min([*open_, *([] if quiet is None else [quiet])])
            if told:
                own = list(zip(*[k for k, _ in told]))  # keys come first
                columns = [list(own[i]) if i < len(own) else [None] * len(told) for i in range(len(self.carried))]
                yield self._frame(columns, [r for _, r in told], False)
        self._set(first, quiet, known)
