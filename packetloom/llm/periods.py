"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are the same) and at least three
periods that no neighbouring word extends. Every text is searched whole, many texts at a time as one array of word numbers
with a symbol of its own after each text:

* Small periods, below ``3 * BASE``: comparing the array with itself moved by each of them shows all such runs at once,
  the highly periodic regions among them.
* At each scale ``t = BASE, 2 * BASE, ...`` a synchronising set is chosen by hashes: position ``i`` belongs to it if the
  smallest hash of the ``t``-word substrings that begin at ``i .. i + t`` is that of the first or the last one. Substrings
  with a period of ``t / 3`` or less take no part; they lie in runs that smaller scales have found. Membership
  depends on the ``2 * t`` words at ``i`` alone, so equal contexts are chosen alike, and a run with period ``3t <= q < 6t``
  has a chosen position within its first period plus ``t`` whose context comes back ``q`` words later.
* Positions with equal contexts less than ``6t`` apart (eighteen at most, as contexts are not periodic) propose their
  distance as period. Proposals are extended to both sides by hashes of prefixes and the stretch is compared word by word.
* A stretch whose period is a multiple of a smaller one has the bounds of that one's run, which is known already.

Words are numbered exactly, hashes only guide the search: a collision can cost time, never change a result. Work is
``n log n`` in the words of a text and memory in proportion to its longest text; texts are searched independently.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated rows are searched
separately and come back as often; an empty table gives an empty table; a very long text is searched whole, however long
its words or periods are; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.text import chunks, mix

#: The smallest scale; periods below three times as much are compared directly.
BASE = 4
WORD = r"[^\x20\x09-\x0D]+"
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ODD = np.uint64(0xD6E8FEB86659FD93)
_NEVER = np.uint64(2**64 - 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, np.uint64(pow(int(_ODD), -1, 2**64)))):
            table = np.full(2 * n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


class Substrings:
    """Hashes of all substrings of an array of symbols."""

    def __init__(self, x: np.ndarray):
        powers, self.inverse = power_tables(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(mix(x.astype(np.uint64) + _ODD) * powers[: len(x)], out=self.sums[1:])

    def at(self, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.inverse[starts]

    def each(self, size: int, n: int) -> np.ndarray:
        """Of the substrings of ``size`` that begin at 0, 1, ... and end by ``n``."""
        return (self.sums[size : n + 1] - self.sums[: n + 1 - size]) * self.inverse[: n + 1 - size]


def _stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each series of consecutive numbers."""
    cut = np.flatnonzero(np.diff(hits) > 1)
    return hits[np.r_[0, cut + 1]], hits[np.r_[cut, len(hits) - 1]]


def _extend(text: Substrings, n: int, one: np.ndarray, two: np.ndarray, forward: bool, longest: int) -> np.ndarray:
    """How far the words from ``one`` and ``two`` on (or before them) are the same, by halving steps."""
    done = np.zeros(len(one), np.int64)
    step = 1 << max(longest, 1).bit_length()
    while step:
        room = two + done + step <= n if forward else one - done - step >= 0
        if room.any():
            a, b = one[room], two[room]
            shift = done[room] if forward else -done[room] - step
            same = text.at(a + shift, step) == text.at(b + shift, step)
            done[np.flatnonzero(room)[same]] += step
        step >>= 1
    return done


def _synchronising(text: Substrings, n: int, t: int, runs: dict) -> np.ndarray:
    """Chosen positions at scale ``t`` in the first ``n`` symbols."""
    ids = mix(text.each(t, n)) >> np.uint64(1)
    for (start, end), period in runs.items():
        if 3 * period <= t <= end - start and start < len(ids):
            ids[start : end - t + 1] = _NEVER
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    m = len(least)
    return np.flatnonzero((least != _NEVER) & ((least == ids[:m]) | (least == ids[t : t + m])))


def _proposals(text: Substrings, chosen: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of equal contexts between ``3t`` and ``6t`` apart."""
    context = text.at(chosen, 2 * t)
    order = np.argsort(context, kind="stable")
    context, place = context[order], chosen[order]
    starts, periods, k = [], [], 1
    while k < len(place):
        near = np.flatnonzero((context[k:] == context[:-k]) & (place[k:] - place[:-k] < 6 * t))
        if not len(near):
            break
        gap = place[near + k] - place[near]
        starts.append(place[near][gap >= 3 * t])
        periods.append(gap[gap >= 3 * t])
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *periods])


def runs_of(x: np.ndarray, sizes: list[int]) -> dict[tuple[int, int], int]:
    """``(start, end) -> smallest period`` of all runs of three periods or more.

    ``x`` holds the symbols of texts of the given sizes, longest first, each followed by a symbol found nowhere else.
    """
    runs: dict[tuple[int, int], int] = {}
    n = len(x)
    for p in range(1, 3 * BASE):
        hits = np.flatnonzero(x[:-p] == x[p:]) if n > p else np.zeros(0, np.int64)
        if len(hits):
            first, last = _stretches(hits)
            long = last - first + 1 >= 2 * p
            for s, e in zip(first[long].tolist(), (last[long] + 1 + p).tolist()):
                runs.setdefault((s, e), p)
    t, sizes_ = BASE, np.array(sizes, np.int64)
    text = Substrings(x) if len(sizes) and sizes[0] >= 9 * t else None
    while len(sizes) and sizes[0] >= 9 * t:
        n = int((sizes_[sizes_ >= 9 * t] + 1).sum())
        chosen = _synchronising(text, n, t, runs)
        at, period = _proposals(text, chosen, t)
        if len(at):
            ahead = _extend(text, n, at, at + period, True, sizes[0])
            back = _extend(text, n, at, at + period, False, sizes[0])
            found = np.unique(np.stack([at - back, at + period + ahead, period]), axis=1)
            for s, e, p in found.T.tolist():
                if not np.array_equal(x[s : e - p], x[s + p : e]):  # two hashes met: go word by word from the context
                    inner = at[(period == p) & (at >= s) & (at < e)]
                    for i in inner.tolist():
                        s, e = i, i + p
                        while e < n and x[e] == x[e - p]:
                            e += 1
                        while s > 0 and x[s - 1] == x[s - 1 + p]:
                            s -= 1
                        if e - s >= 3 * p:
                            runs.setdefault((s, e), p)
                elif e - s >= 3 * p:
                    runs.setdefault((s, e), p)
        t *= 2
    return runs


def search(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each list of words, by start, then period."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    for rank, k in enumerate(order):
        flat += [numbers.setdefault(w, len(numbers)) for w in words[k]]
        flat.append(-1 - rank)
    sizes = [len(words[k]) for k in order]
    first = np.cumsum([0, *[s + 1 for s in sizes]])
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for (s, e), p in runs_of(np.array(flat, np.int64), sizes).items():
        rank = int(np.searchsorted(first, s, "right")) - 1
        found[order[rank]].append((s - int(first[rank]), e - s, p))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def periodic_runs(docs: DataFrame, min_words: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row: the runs of ``min_words`` words and three periods or more as
    ``array<struct<start, length, period>>`` by start, then period, and the words joined by one space without those
    that any run contains after its first period."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                words = [(t or "").encode().split() for t in batch.column(1)[lo:hi].to_pylist()]
                found = [[r for r in f if r[1] >= min_words] for f in search(words)]
                texts = []
                for ws, f in zip(words, found):
                    if f:
                        drop = bytearray(len(ws))
                        for s, size, p in f:
                            drop[s + p : s + size] = b"\x01" * (size - p)
                        ws = [w for w, d in zip(ws, drop) if not d]
                    texts.append(b" ".join(ws))
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                runs = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=RUN.names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([len(w) for w in words], pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())],
                    names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(find, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a stretch of words repeated to the end, in one document of ten, chosen by the checksum of its id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("_words"))
    n, copies = F.size("_words"), (3 + F.col("_g") % 8).cast("int")
    docs = docs.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))  # a column of its own, so that words are found once
    rest = n - F.col("_a")
    period = (1 + F.floor(rest / copies)).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, period), copies)), F.lit(1), rest)
    return docs.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods; of equal ones the first, then that of the smallest period."""
    def better(best, r):
        more = (r["length"] * best["period"]) > (best["length"] * r["period"])  # runs come by start, then period
        return F.when(best.isNull() | more, r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)
