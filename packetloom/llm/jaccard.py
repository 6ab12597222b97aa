"""Jaccard join of documents' word shingles with skipping by set relations.

Each distinct set of shingles is indexed under its prefix: its first tokens in one global order, long enough
that two similar sets share one. Tokens that many documents hold come last in that order, so the lists of
common passages stay out of the prefixes of texts that only contain them.

* Index lists are kept by the token's position in the set. A block of entries whose position leaves too few
  tokens behind it cannot reach the overlap, and is skipped as a whole.
* Answers are derived from those of a similar set: every set in a list is compared with one leader, sets linked
  with it form a component, and only entries of different components are compared further. For these, the
  distances to a common leader decide most pairs, as Jaccard distance is a metric.

The result is exact: every link between different texts is found or implied by links that are. Copies are
collapsed first and never compared.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text
with fewer words than a shingle is one shingle; repeated rows are in one component; a component whose documents all
lack an id has no id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.components import components
from packetloom.llm.text import LOWER, Words, buffers, chunks, mix
from packetloom.session import durable

BUCKET_BITS = 22  # counters of the sketch that orders tokens; 2**22 bits reach every task
BLOCK = 1 << 16
FILTER_BITS = 24  # bits of the filter for texts whose sets are needed again
_K = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, one text after the other, and the texts' offsets."""
    data, offsets = buffers(texts)
    words = Words(LOWER[data], offsets)
    h = words.hashes()
    n = np.diff(words.first)
    shingles = np.zeros(len(h), np.uint64)
    for k in range(size):
        shingles[: max(len(h) - k, 0)] += h[k:] * _K[k]
    last = np.repeat(words.first[1:], n)
    place = np.arange(len(h))
    whole = place + size <= last
    for i in np.flatnonzero((n > 0) & (n < size)):  # the whole sequence as one
        a, b = words.first[i], words.first[i + 1]
        shingles[a] = (h[a:b] * _K[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        whole[a] = True
    shingles = mix(shingles[whole])
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.r_[0, np.cumsum(counts)]
    for a, b in zip(ends[:-1], ends[1:]):
        shingles[a:b].sort()
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = shingles[1:] != shingles[:-1]
    fresh[ends[:-1][counts > 0]] = True
    return shingles[fresh], np.r_[0, np.cumsum(fresh)][ends]


def ordered(sets: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The sets as tokens in the global order: those in common buckets after all others, each by hash."""
    bucket = sets >> np.uint64(64 - BUCKET_BITS)
    flag = (common[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1
    tokens = (sets >> np.uint64(1)) | (flag.astype(np.uint64) << np.uint64(63))
    for a, b in zip(offsets[:-1], offsets[1:]):
        tokens[a:b].sort()
    return tokens


def fingerprints(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set."""
    sums = [np.r_[np.uint64(0), np.cumsum(mix(tokens ^ _K[k]), dtype=np.uint64)] for k in (14, 15)]
    return np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums])


def common_buckets(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """A bit for each bucket of shingles that holds many more documents' shingles than the mean bucket.

    Counted over all documents (a task's count of a bucket stops at 255); only the order of tokens depends on it, not the result. Bounded: 2**22 bits.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                sets, _ = shingle_sets(batch.column(0)[lo:hi], size)
                np.add.at(total, (sets >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        if total.any():
            blocks = np.minimum(total, 255).astype(np.uint8).reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(block, np.zeros(BLOCK, np.int64))
                own += np.frombuffer(counts.as_buffer(), np.uint8)
        bits = []
        for own in sums.values():
            mean = own.mean()
            bits.append(np.packbits(own > mean + 4 * np.sqrt(mean) + 4, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    blocks = (1 << BUCKET_BITS) // BLOCK
    counted = docs.select(text_col).mapInArrow(count, "block int, counts binary").repartition(blocks, "block")
    out = np.zeros((blocks, BLOCK // 8), np.uint8)
    for row in counted.mapInArrow(reduce, "block int, bits binary").collect():  # one small row per block
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def needed(n, pct: int):
    """The least overlap of a set of ``n`` with any similar set."""
    return _div(pct * n + 99, 100)


def _div(a, b: int):
    return F.floor(a / b) if isinstance(a, Column) else a // b


def shared(n, pct: int):
    """How many tokens the prefix of a set of ``n`` shares at least with that of any similar, not smaller set."""
    return 1 + _div(needed(n, pct), 16)


def compatible(n1, p1, n2, p2, pct: int, among_first: bool = False):
    """Whether sets of these sizes may be similar if their first common token is at these positions; ``among_first``:
    if it is one of the common tokens that their prefixes share at least."""
    least = (pct * (n1 + n2) + 99 + pct) // (100 + pct)
    if among_first:
        least = least - shared(np.minimum(n1, n2), pct) + 1
    fits = (100 * np.minimum(n1, n2) >= pct * np.maximum(n1, n2))
    return fits & (np.minimum(n1 - p1, n2 - p2) >= least)


def indexed(docs: DataFrame, id_col: str, text_col: str, size: int, pct: int, common: np.ndarray) -> DataFrame:
    """``doc_id, n, fp1, fp2, prefix`` of each document."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in ("n", "fp1", "fp2")] + [
        T.StructField("prefix", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                sets, offsets = shingle_sets(batch.column(1)[lo:hi], size)
                tokens = ordered(sets, offsets, common)
                n = np.diff(offsets)
                fp = fingerprints(tokens, offsets).view(np.int64)
                keep = np.where(n > 0, n - needed(n, pct) + shared(n, pct), 0)
                inside = np.arange(len(tokens)) - np.repeat(offsets[:-1], n) < np.repeat(keep, n)
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype(np.int32)), pa.array(tokens[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n), pa.array(fp[0]), pa.array(fp[1]), prefix], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], several: str) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """Pieces of lists from batches sorted by token: whether a new list begins, and the columns of the piece.

    Lists that lie within a batch and have one value of ``several`` are passed over."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        token = cols["token"]
        starts = np.r_[0, np.flatnonzero(token[1:] != token[:-1]) + 1]
        ends = np.r_[starts[1:], len(token)]
        use = np.maximum.reduceat(cols[several], starts) != np.minimum.reduceat(cols[several], starts)
        use[[0, -1]] = True
        for a, b in zip(starts[use].tolist(), ends[use].tolist()):
            yield a > 0 or token[0] != last, {k: v[a:b] for k, v in cols.items()}
        last = token[-1]


def leader_pairs(pct: int) -> Callable:
    """Each entry of a list with the first leader that it may be similar to; an entry without one becomes a leader
    and a pair with itself. So a set is in at least as many pairs as there are lists in which something goes with it.

    Lists arrive by position, so leaders are the sets with the fewest rare tokens. A list is read in pieces and
    only its leaders are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: list[tuple[int, int, int]] = []
        out: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["x", "y"])

        held = 0
        for new, c in runs(batches, "sid"):
            if new:
                leaders = []
            sid, n, pos = c["sid"], c["n"], c["pos"]
            rest = np.arange(len(sid))
            for leader, ln, lp in leaders:
                fits = compatible(n[rest], pos[rest], ln, lp, pct, True)
                out.append(np.stack([sid[rest[fits]], np.full(int(fits.sum()), leader)]))
                rest = rest[~fits]
            while len(rest):
                k = rest[0]
                rest = rest[1:]
                fits = compatible(n[rest], pos[rest], n[k], pos[k], pct, True)
                out.append(np.full((2, 1), sid[k]))
                leaders.append((int(sid[k]), int(n[k]), int(pos[k])))
                out.append(np.stack([sid[rest[fits]], np.full(int(fits.sum()), sid[k])]))
                rest = rest[~fits]
            held += len(sid)
            if held > 50_000:
                yield flush()
                held = 0
        yield flush()

    return run


def cross_pairs(pct: int) -> Callable:
    """Pairs of a list that are in different components and that no known distance decides."""
    limit = 1 - pct / 100 + 1e-9

    def pairs(c: dict[str, np.ndarray]) -> np.ndarray:
        values, names, counts = np.unique(c["root"], return_inverse=True, return_counts=True)
        if len(values) < 2:
            return np.zeros((2, 0), np.int64)
        seen, found, largest = np.zeros(len(names), bool), [], counts.argmax()
        for k in np.argsort(counts[names], kind="stable"):  # small components first, the largest is only ever compared with
            if names[k] == largest:
                continue
            seen[k] = True
            other = (names != names[k]) & ~seen
            at = np.flatnonzero(other & compatible(c["n"], c["pos"], c["n"][k], c["pos"][k], pct))
            far = (c["leader"][at] == c["leader"][k]) & (np.abs(c["d"][at] - c["d"][k]) > limit)
            at = at[~far]
            found.append(np.stack([np.full(len(at), c["sid"][k]), c["sid"][at]]))
        found = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return np.stack([found.min(axis=0), found.max(axis=0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        known = np.zeros((2, 0), np.int64)

        def close() -> np.ndarray:
            return pairs({k: np.concatenate([p[k] for p in parts]) for k in parts[0]}) if parts else known[:, :0]

        for new, c in runs(batches, "root"):
            if new:
                known = np.concatenate([known, close()], axis=1)
                parts = []
            parts.append(c)
            if known.shape[1] > 100_000:
                known = np.unique(known, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(known[0]), pa.array(known[1])], names=["x", "y"])
                known = known[:, :0]
        known = np.unique(np.concatenate([known, close()], axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(known[0]), pa.array(known[1])], names=["x", "y"])

    return run


def wanted_bits(classes: DataFrame) -> np.ndarray:
    """A filter of 2**24 bits with the texts whose sets have to be read again."""
    named = F.crc32(F.coalesce(F.col("rep").cast("string"), F.lit("")).cast("binary"))
    bit = F.col("fp1").bitwiseXOR(named).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    groups = classes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("g")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << FILTER_BITS >> 15, 4096), np.uint8)
    for row in groups.collect():  # at most 512 rows of 4 KB
        out[row.g - 1] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def read_sets(docs: DataFrame, id_col: str, text_col: str, size: int, common: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """``doc_id, fp1, fp2, tokens`` of the documents that pass the filter."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()),
                           T.StructField("tokens", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                ids = batch.column(0)[lo:hi]
                sets, offsets = shingle_sets(batch.column(1)[lo:hi], size)
                tokens = ordered(sets, offsets, common)
                fp = fingerprints(tokens, offsets)
                named = np.array([0 if i is None else zlib.crc32(str(i).encode()) for i in ids.to_pylist()], np.uint64)
                bit = (fp[0] ^ named) & np.uint64((1 << FILTER_BITS) - 1)
                use = (wanted[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                n = np.diff(offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[use])].astype(np.int32)), pa.array(tokens[np.repeat(use, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(use)), pa.array(fp[0].view(np.int64)[use]), pa.array(fp[1].view(np.int64)[use]), lists], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """``x, y, d, linked``: the exact Jaccard distance of each pair."""
    one = sets.select(F.col("sid").alias("x"), F.col("tokens").alias("tx"))
    two = sets.select(F.col("sid").alias("y"), F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    j = pairs.join(one, "x").join(two, "y").select("x", "y", both.alias("i"), (F.size("tx") + F.size("ty")).alias("s"))
    union = F.col("s") - F.col("i")
    return j.select("x", "y", (1 - F.col("i") / union).alias("d"), (100 * F.col("i") >= pct * union).alias("linked"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, pct: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_size`` for every row: documents are linked when their sets of ``size``-word
    shingles have a Jaccard similarity of ``pct`` percent or more. ``component_id`` is the smallest id reachable by links;
    ``class_size`` counts the documents with exactly this set."""
    common = common_buckets(docs, text_col, size)
    rows = durable(indexed(docs, id_col, text_col, size, pct, common))
    classes = rows.filter("n > 0").groupBy("fp1", "fp2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("class_size"))
    classes = durable(classes.withColumn("sid", F.monotonically_increasing_id()))

    entries = classes.select("sid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", F.col("pos").cast("long"), "n", "sid")
    entries = entries.repartition("token").sortWithinPartitions("token", "pos", "n", "sid")
    votes = durable(entries.mapInArrow(leader_pairs(pct), "x long, y long").groupBy("x", "y").agg(F.count("*").alias("votes")))
    least = needed(F.col("n"), pct).cast("long")  # the smallest set that is similar to one of n
    enough = F.col("lists") >= shared(least, pct).cast("long")
    touched = votes.groupBy(F.col("x").alias("sid")).agg(F.sum("votes").alias("lists"))
    involved = durable(classes.join(touched, "sid").filter(enough).select("sid", "fp1", "fp2", "rep", "n", "prefix"))

    sets = read_sets(docs, id_col, text_col, size, common, wanted_bits(involved))
    names = involved.select("sid", "fp1", "fp2", "rep")
    sets = durable(sets.join(names, ["fp1", "fp2"]).filter(F.col("doc_id").eqNullSafe(F.col("rep"))).select("sid", "tokens"))

    inside = involved.select("sid")
    pairs = votes.filter("x <> y").join(inside.withColumnRenamed("sid", "x"), "x", "left_semi").join(inside.withColumnRenamed("sid", "y"), "y", "left_semi")
    best = pairs.groupBy("x").agg(F.max_by("y", F.struct("votes", "y")).alias("y"))
    first = durable(verified(best, sets, pct))
    links = first.filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))

    near = first.groupBy(F.col("x").alias("sid")).agg(F.first("y").alias("leader"), F.first("d").alias("d"))
    known = involved.select("sid", "n", "prefix").join(components(links).withColumnRenamed("node", "sid"), "sid", "left").join(near, "sid", "left")
    known = known.select("sid", "n", F.coalesce("root", "sid").alias("root"), F.coalesce("leader", "sid").alias("leader"), F.coalesce("d", F.lit(0.0)).alias("d"), "prefix")
    entries = known.select("sid", "n", "root", "leader", "d", F.posexplode("prefix").alias("pos", "token"))
    entries = entries.select("token", F.col("pos").cast("long"), "n", "sid", "root", "leader", "d")
    entries = entries.repartition("token").sortWithinPartitions("token", "pos", "n", "sid")
    rest = entries.mapInArrow(cross_pairs(pct), "x long, y long").distinct()
    second = durable(verified(rest, sets, pct).filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))

    roots = components(links.unionByName(second))
    member = classes.select("sid", "rep").join(roots.withColumnRenamed("node", "sid"), "sid")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = member.join(least, "root").select("sid", "component_id")
    found = classes.select("sid", "fp1", "fp2", "rep", "class_size").join(found, "sid", "left").select(
        "fp1", "fp2", F.coalesce("component_id", "rep").alias("component_id"), "class_size")
    full = rows.filter("n > 0").select("doc_id", "n", "fp1", "fp2").join(found, ["fp1", "fp2"])
    full = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size")
    return full.unionByName(rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id. Rows that share an id and a text are one. A row
    without an id cannot be named as the one that stays, nor as a copy: it stays."""
    found = similar_documents(docs, id_col, text_col, **options)
    stay = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.join(stay, F.col(id_col) == F.col("_stay"), "left_semi")
    twin = W.partitionBy(id_col, F.md5(F.coalesce(F.col(text_col), F.lit("")))).orderBy(F.lit(0))
    named = named.withColumn("_twin", F.row_number().over(twin)).filter("_twin = 1").drop("_twin")
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
