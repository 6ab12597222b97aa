"""Packing token sequences: gaps are filled exactly by one, two or three pieces, the rest goes best-fit.

Only the number of pieces of each length decides a packing, and there are at most ``capacity`` lengths. So
the histogram is planned on the driver (its size does not depend on the data) as patterns of lengths with
multiplicities, and the pieces take their places by their rank among pieces of the same length.

Defined results: a null or empty text is a piece of the closing id alone; repeated rows are packed
separately; an empty table gives an empty packing; other columns are not read, whatever their names. A very long text, or a
very long word in one, is read whole, in time in proportion to it, and cut into full pieces. Pieces of equal length are
interchangeable and take their places in the order of ids and pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.text import chunks
from packetloom.llm.tokens import tokenizer
from packetloom.session import durable

RANK_SLICES = 1024


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only beyond ``capacity``."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [
        T.StructField(n, T.IntegerType() if n == "piece" else T.LongType()) for n in ("piece", "start", "length", "ids_crc32")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in chunks(texts):
                flat, offsets = tok.ids(texts[lo:hi])
                rows, made = [], []
                for k in range(hi - lo):
                    own = np.append(flat[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p in range(0, len(own), capacity):
                        part = own[p : p + capacity]
                        rows.append(lo + k)
                        made.append((p // capacity, p, len(part), zlib.crc32(part.tobytes())))
                piece, start, length, crc = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def exact_fill(gap: int, left: np.ndarray, used: tuple[int, ...]) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, larger ones first; ``used`` are taken already."""
    have = left.copy()
    for u in used:
        have[u] -= 1

    def pair(g: int, have: np.ndarray) -> tuple[int, int] | None:
        if g < 2:
            return None
        big = np.arange((g + 1) // 2, g)
        ok = (have[big] > 0) & (have[g - big] > 0)
        if g % 2 == 0:
            ok[0] &= have[g // 2] > 1
        found = np.flatnonzero(ok)
        return (int(big[found[-1]]), int(g - big[found[-1]])) if len(found) else None

    if have[gap] > 0:
        return (gap,)
    if two := pair(gap, have):
        return two
    for a in np.flatnonzero(have[: gap - 1] > 0)[::-1]:
        have[a] -= 1
        if two := pair(gap - int(a), have):
            return (int(a), *two)
        have[a] += 1
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every counted piece is in exactly one pattern."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rest: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            fill = exact_fill(capacity - length, left, (length,))
            if fill is None:
                rest.append((length, int(left[length])))
                left[length] = 0
                break
            pattern = (length, *fill)
            times = min(int(left[x]) // n for x, n in Counter(pattern).items())
            for x in pattern:
                left[x] -= times
            done.append((pattern, times))
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, n in rest:  # largest first, each into the tightest gap
        while n:
            gap = min((g for g, bins in open_bins.items() if g >= length and bins), default=None)
            if gap is None:
                per = capacity // length
                times, each = (n // per, per) if n >= per else (1, n)
                open_bins.setdefault(capacity - each * length, []).append(((length,) * each, times))
                n -= times * each
                continue
            pattern, times = open_bins[gap].pop()
            per = gap // length
            if n >= per:
                now, each = min(times, n // per), per
            else:
                now, each = 1, n
            if times > now:
                open_bins[gap].append((pattern, times - now))
            open_bins.setdefault(gap - each * length, []).append((pattern + (length,) * each, now))
            n -= now * each
    return done + [x for bins in open_bins.values() for x in bins]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, lo, hi, sequence, offset``: ranks lo to hi - 1 of a length go to sequences from ``sequence`` on."""
    rank: Counter = Counter()
    base, rows = 0, []
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], rank[length] + times, base, offset))
            rank[length] += times
            offset += length
        base += times
    return rows


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` must give the same rows each time it is read (a table): its histogram comes first.
    """
    spark = pieces.sparkSession
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_SLICES)))
    counts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("length", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = sliced.withColumn("_inside", inside).join(before, ["length", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_inside"))
    rows = places(plan(histogram, capacity))
    table = spark.createDataFrame(rows, "length long, _lo long, _hi long, _base long, offset long")
    joined = ranked.join(F.broadcast(table), "length").filter("_rank >= _lo and _rank < _hi")  # the plan's size depends on ``capacity`` alone
    return joined.select(*pieces.columns, (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, **options) -> DataFrame:
    return pack(durable(token_pieces(docs, path, capacity, **options)), capacity)
