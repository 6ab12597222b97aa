"""Lempel-Ziv phrase fingerprints: texts are alike when they would compress with the same dictionary.

A text's UTF-8 bytes are parsed into dictionary phrases, each the longest phrase known so far and one byte more (LZ78).
Every phrase is hashed by its content, and the ``size`` smallest 32-bit hashes of the phrase set are the fingerprint,
in rising order, eight hexadecimal digits each. The likeness of two fingerprints is the share of common hashes among the ``size``
smallest of both together: an estimate of the Jaccard similarity of the phrase sets, and exactly that for sets of up to ``size``.

``edit_likeness`` also fingerprints an edited text, whose last half comes from the next document. Rows are dealt to
ranges of ids, each one sorted, and the first row of a range is handed to the range above it as well, so one shuffle of the
table and one percentile sketch of the ids is all it takes; a parse is kept at the cut, so the unchanged half is
parsed once.

Defined results: a null text is an empty one, without phrases and with an empty fingerprint; two empty fingerprints have likeness 1, an
empty and another one 0. Rows of the same id follow each other by text; a null id comes after all others. Repeated rows are
fingerprinted each; an empty table gives an empty table. A very long text is parsed whole, in linear time and in memory in
proportion to it. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.periods import Substrings
from packetloom.llm.text import chunks, mix

SIZE = 128
_LOWEST = -(2**63)


def parse(data: bytes, known: dict[int, int], node: int, ends: list[int], at: int = 0) -> int:
    """Go on parsing with ``data``, which begins at byte ``at``: new phrases go to ``known``, their ends to ``ends``.

    ``known`` maps a phrase and a byte to the longer phrase; returns the phrase reached, 0 at a phrase's end.
    """
    find, add = known.get, ends.append
    for i, byte in enumerate(data, at + 1):
        key = node + byte
        node = find(key, 0)
        if not node:
            add(i)
            known[key] = len(ends) << 8
    return node


def sketches(texts: list[bytes], ends: list[list[int]], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The smallest distinct phrase hashes of all texts, one text after the other, and where each text's begin."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0, *map(len, texts)])
    counts = np.array([len(e) for e in ends], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    stop = np.concatenate([np.zeros(0, np.int64), *[np.array(e, np.int64) for e in ends]]) + base[owner]
    start = np.r_[0, stop[:-1]] if len(stop) else stop
    first = (np.cumsum(counts) - counts)[counts > 0]
    start[first] = base[:-1][counts > 0]
    hashes = mix(Substrings(data).at(start, stop - start)) >> np.uint64(32)
    keys = np.unique(owner.astype(np.uint64) << np.uint64(32) | hashes)
    owner = (keys >> np.uint64(32)).astype(np.int64)
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    keep = np.arange(len(keys)) - offsets[owner] < size
    return (keys[keep] & np.uint64(2**32 - 1)).astype(np.uint32), np.r_[0, np.cumsum(np.minimum(np.diff(offsets), size))]


def _hex(flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    text = flat.astype(">u4").tobytes().hex()
    return [text[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def alike(one: np.ndarray, ends_one: np.ndarray, two: np.ndarray, ends_two: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Likeness of the k-th sketch of ``one`` and the k-th of ``two``, for every k."""
    n = len(ends_one) - 1
    keys = np.sort(np.concatenate([
        np.repeat(np.arange(n), np.diff(ends)).astype(np.uint64) << np.uint64(32) | flat for flat, ends in ((one, ends_one), (two, ends_two))]))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    both = np.zeros(len(keys), bool)
    both[:-1] = ~fresh[1:]
    union, both = keys[fresh], both[fresh]
    owner = (union >> np.uint64(32)).astype(np.int64)
    offsets = np.searchsorted(owner, np.arange(n + 1))
    low = np.arange(len(union)) - offsets[owner] < size
    total = np.bincount(owner[low], minlength=n)
    common = np.bincount(owner[low & both], minlength=n)
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def fingerprints(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_phrases, fingerprint`` for every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_phrases", T.LongType()),
                           T.StructField("fingerprint", T.StringType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                texts = [(t or "").encode() for t in batch.column(1)[lo:hi].to_pylist()]
                ends: list[list[int]] = [[] for _ in texts]
                for t, e in zip(texts, ends):
                    parse(t, {}, 0, e)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([len(e) for e in ends], pa.int64()), pa.array(_hex(*sketches(texts, ends, size)), pa.string())],
                    names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(sketch, schema)


def likeness(size: int = SIZE):
    """A function of two fingerprint columns of that size: 0 to 1, null if one of them is null."""
    @F.arrow_udf("double")
    def compare(one: pa.Array, two: pa.Array) -> pa.Array:
        sides = []
        for column in (one, two):
            texts = [t or "" for t in column.to_pylist()]
            flat = np.frombuffer(bytes.fromhex("".join(texts)), ">u4").astype(np.uint32)
            sides += [flat, np.cumsum([0, *[len(t) // 8 for t in texts]])]
        missing = np.array([a is None or b is None for a, b in zip(one.to_pylist(), two.to_pylist())], bool)
        return pa.array(alike(*sides, size), mask=missing)

    return compare


def in_turn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_halo, doc_id, text``: partitions of rows in falling order of ids, each followed by the row that comes next in the
    table (``_halo`` = 1), the first one again after the last.

    The ranges' bounds are ids of the table, one for each shuffle partition at most; a bound's row opens its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("_key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = rows.agg(F.percentile_approx("_key", shares, max(10_000, 20 * parts)).alias("inner"), F.max("_key").alias("top")).first()
    bounds = np.array(sorted({*(found.inner or []), *([] if found.top is None else [found.top])}), np.int64)

    @F.arrow_udf("array<int>")
    def ranges(keys: pa.Array) -> pa.Array:
        values = keys.to_numpy(zero_copy_only=False)
        part = np.searchsorted(bounds, values)
        twice = bounds[part] == values  # opens its range, so it also closes the one above, or the lowest one
        flat = np.stack([part, (part + 1) % len(bounds)], 1)[np.stack([np.ones(len(part), bool), twice], 1)]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(1 + twice)], pa.int32()), pa.array(flat, pa.int32()))

    dealt = rows.select("*", F.posexplode(ranges("_key")).alias("_halo", "_part"))
    dealt = dealt.repartitionById(max(len(bounds), 1), F.col("_part"))
    return dealt.sortWithinPartitions("_part", "_halo", F.desc("_key"), "text").select("_halo", "doc_id", "text")


def edit_likeness(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row; ids are whole numbers.

    The edited text has the last half of the code points, rounded down, replaced by as many first ones of the next document.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType())] + [
        T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")] + [
        T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for lo, hi in chunks(batch.column(2)):
                halo, ids, texts = (old + batch.column(k)[lo:hi].to_pylist() for k, old in enumerate(waiting))
                waiting = (halo[-1:], ids[-1:], texts[-1:])  # its next row is not here yet
                whole, ends, edited, edited_ends = [], [], [], []
                for k, text in enumerate(texts):
                    cut = len(text) - len(text) // 2
                    head = text[:cut].encode()
                    known, own = {}, []
                    node = parse(head, known, 0, own)
                    if k + 1 < len(texts) and not halo[k]:
                        tail = texts[k + 1][: len(text) // 2].encode()
                        other = own.copy()
                        parse(tail, known.copy(), node, other, len(head))
                        edited.append(head + tail)
                        edited_ends.append(other)
                    parse(text[cut:].encode(), known, node, own, len(head))
                    whole.append(text.encode())
                    ends.append(own)
                rows = [k for k in range(len(texts) - 1) if not halo[k]]
                own, own_at = sketches(whole, ends, size)
                new, new_at = sketches(edited, edited_ends, size)
                prints = _hex(own, own_at)

                def side(ks):
                    parts = [own[own_at[k] : own_at[k + 1]] for k in ks]
                    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])

                mine = side(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in rows], batch.column(1).type), pa.array([len(texts[k]) for k in rows], pa.int64()),
                     pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array([prints[k] for k in rows], pa.string()),
                     pa.array(_hex(new, new_at), pa.string()), pa.array(alike(*mine, new, new_at, size)),
                     pa.array(alike(*mine, *side([k + 1 for k in rows]), size))],
                    names=schema.names)

    return in_turn(docs, id_col, text_col).mapInArrow(compare, schema)
