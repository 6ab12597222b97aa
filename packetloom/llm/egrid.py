"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine ``c`` or more are within ``sqrt(2 - 2c)`` of each other. Vectors are projected on their leading
principal dimensions, put into grid cells of that width and sorted by cell. The sequence is cut into intervals; pairs of
intervals whose boxes are farther apart than the width hold no link and are skipped, first between intervals and then,
recursively, inside a pair. What is left is compared in double precision.

Copies of a vector are compared once. A pair of intervals returns the number of links of each vector and a spanning
forest of its links, so a dense group never produces all its pairs as rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do
vectors of different lengths; repeated rows are separate vectors that link with each other; a component without any id
has none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.session import durable

INTERVAL_BYTES = 4 << 20
LEAF = 256
LEADING = 6


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, key``: the vector as doubles and a digest of it; both null if it links with nothing."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    d = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"))
    d = d.withColumn("v", F.when(F.col("v").isNotNull() & ~bad, F.col("v")))
    # squares of very large or very small components leave the range of doubles; such vectors are compared by direction at scale 1
    d = d.withColumn("_most", F.array_max(F.transform("v", lambda x: F.abs(x))))
    extreme = (F.col("_most") > 1e100) | (F.col("_most") < 1e-100)
    d = d.withColumn("v", F.when(extreme & (F.col("_most") > 0), F.transform("v", lambda x: x / F.col("_most"))).otherwise(F.col("v"))).drop("_most")
    d = d.withColumn("v", F.when((size > 0) & (size < float("inf")), F.col("v")))
    return d.withColumn("key", F.md5(F.to_json(F.struct("v")))).withColumn("key", F.when(F.col("v").isNotNull(), F.col("key")))


def unit(column: pa.ListArray, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy().reshape(-1, dim)
    return m / np.sqrt((m * m).sum(1))[:, None]


def leading_dimensions(classes: DataFrame, dim: int) -> np.ndarray:
    """The principal dimensions of the unit vectors; each task returns one sum of ``dim`` squared numbers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = unit(batch.column(0), dim)
                n, s, c = n + len(u), s + u.sum(0), c + u.T @ u
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[float(n), *s, *c.ravel()]])], names=["m"])

    total = np.sum([r.m for r in classes.select("v").mapInArrow(moments, "m array<double>").collect()], axis=0)
    n, mean, second = total[0], total[1 : dim + 1] / total[0], total[dim + 1 :].reshape(dim, dim) / total[0]
    _, basis = np.linalg.eigh(second - np.outer(mean, mean))
    return basis[:, ::-1][:, : min(LEADING, dim)]


def intervals(classes: DataFrame, dim: int, basis: np.ndarray, width: float) -> DataFrame:
    """``block, lo, hi, cids, weights, vectors``: vectors in the order of their cells, cut into intervals."""
    k = basis.shape[1]
    names = [f"c{i}" for i in range(k)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.floor(unit(batch.column(2), dim) @ basis / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c[:, i]) for i in range(k)]], names=["cid", "weight", "v", *names])

    schema = "cid long, weight long, v array<double>, " + ", ".join(f"{n} int" for n in names)
    placed = classes.select("cid", "weight", "v").mapInArrow(cells, schema)
    placed = placed.repartitionByRange(*names, "cid").sortWithinPartitions(*names, "cid").withColumn("part", F.spark_partition_id())
    most = max(LEAF, INTERVAL_BYTES // (8 * dim))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number, part = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            cid, weight, u = (np.concatenate(x) for x in zip(*held))
            y = u @ basis
            held.clear()
            values = [part << 32 | number, y.min(0).tolist(), y.max(0).tolist(), cid.tobytes(), weight.tobytes(), u.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["block", "lo", "hi", "cids", "weights", "vectors"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows = batch.slice(at, most - n)
                part = rows.column(rows.num_columns - 1)[0].as_py()
                held.append((rows.column(0).to_numpy(), rows.column(1).to_numpy(), unit(rows.column(2), dim)))
                n += rows.num_rows
                at += rows.num_rows
                if n == most:
                    yield close()
                    n, number = 0, number + 1
        if n:
            yield close()

    return placed.mapInArrow(cut, "block long, lo array<double>, hi array<double>, cids binary, weights binary, vectors binary")


def near_intervals(blocks: DataFrame, width: float) -> DataFrame:
    """``a, b`` (a <= b): intervals whose boxes are within ``width``; they meet on cells of the first dimension."""
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    boxes = blocks.select("block", "lo", "hi")
    first = F.explode(F.sequence(cell(F.get("lo", F.lit(0))), cell(F.get("hi", F.lit(0)))))
    wider = F.explode(F.sequence(cell(F.get("lo", F.lit(0))) - 1, cell(F.get("hi", F.lit(0))) + 1))
    one = boxes.select(F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), first.alias("cell"))
    two = boxes.select(F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), wider.alias("cell"))
    gap = lambda i: F.greatest(F.get("alo", i) - F.get("bhi", i), F.get("blo", i) - F.get("ahi", i), F.lit(0.0))
    apart = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("alo") - 1), lambda i: gap(i) * gap(i)), F.lit(0.0), lambda s, x: s + x)
    return one.join(two, "cell").filter(F.col("a") <= F.col("b")).filter(apart <= width * width * (1 + 1e-9)).select("a", "b").distinct()


class Forest:
    """Union of numbered nodes; ``edges`` has one pair for each union that mattered."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        known = self.root[i] != self.root[j]
        for a, b in zip(i[known].tolist(), j[known].tolist()):
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.root[max(ra, rb)] = min(ra, rb)
                self.edges.append((a, b))
            self.root[a] = self.root[b] = min(ra, rb)


def join_pair(u: np.ndarray, v: np.ndarray | None, wu: np.ndarray, wv: np.ndarray | None, basis: np.ndarray, width: float, least: float):
    """Links of each vector of two intervals (or of one with itself), counted by weight, and a forest of the links."""
    own = v is None
    size = len(u)
    both, weight = (u, wu) if own else (np.concatenate([u, v]), np.concatenate([wu, wv]))
    links, forest, y = np.zeros(len(both), np.int64), Forest(len(both)), both @ basis

    def box(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return y[a:b].min(0), y[a:b].max(0)

    stack = [((0, size), (0, size) if own else (size, len(both)))]
    while stack:
        (a, b), (c, d) = stack.pop()
        if (a, b) != (c, d):
            (alo, ahi), (clo, chi) = box(a, b), box(c, d)
            gap = np.maximum(np.maximum(alo - chi, clo - ahi), 0)
            if gap @ gap > width * width * (1 + 1e-9):
                continue
        if b - a <= LEAF and d - c <= LEAF:
            hit = both[a:b] @ both[c:d].T >= least
            if (a, b) == (c, d):
                hit = np.triu(hit, 1)
            if hit.any():
                links[a:b] += hit @ weight[c:d]
                links[c:d] += hit.T @ weight[a:b]
                i, j = np.nonzero(hit)
                forest.join(i + a, j + c)
            continue
        if (a, b) == (c, d):
            m = (a + b) // 2
            stack += [((a, m), (a, m)), ((a, m), (m, b)), ((m, b), (m, b))]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [((a, m), (c, d)), ((m, b), (c, d))]
        else:
            m = (c + d) // 2
            stack += [((a, b), (c, m)), ((a, b), (m, d))]
    return links, forest.edges


def class_links(classes: DataFrame, dim: int, least: float) -> DataFrame:
    """``cid, links, other``: partial link counts of distinct vectors (``other`` null), and links that connect them."""
    width = float(np.sqrt(2 - 2 * least)) + 1e-9
    basis = leading_dimensions(classes, dim)
    blocks = durable(intervals(classes, dim, basis, width))
    pairs = near_intervals(blocks, width)
    one = blocks.select(F.col("block").alias("a"), F.col("cids").alias("ca"), F.col("weights").alias("wa"), F.col("vectors").alias("va"))
    two = blocks.select(F.col("block").alias("b"), F.col("cids").alias("cb"), F.col("weights").alias("wb"), F.col("vectors").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                ca, wa, cb, wb = (np.frombuffer(r[k], np.int64) for k in ("ca", "wa", "cb", "wb"))
                u, v = (np.frombuffer(r[k]).reshape(-1, dim) for k in ("va", "vb"))
                own = r["a"] == r["b"]
                links, edges = join_pair(u, None if own else v, wa, None if own else wb, basis, width, least)
                cid = ca if own else np.concatenate([ca, cb])
                some = np.flatnonzero(links)
                e = np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[cid[some], cid[e[:, 0]]]), pa.array(np.r_[links[some], np.zeros(len(e), np.int64)]),
                     pa.array([None] * len(some) + cid[e[:, 1]].tolist(), pa.int64())], names=["cid", "links", "other"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ca", "wa", "va", "cb", "wb", "vb").mapInArrow(run, "cid long, links long, other long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector; linked are vectors with a cosine of ``least`` or more."""
    rows = usable(vectors, id_col, vec_col)
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    found = None
    for dim in [r.dim for r in classes.select("dim").distinct().collect()]:  # vectors of one table have few lengths
        some = class_links(classes.filter(F.col("dim") == dim), dim, least)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = classes.select("cid", F.col("weight").alias("links"), F.col("cid").alias("other"))
    found = durable(found)
    roots = components(found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    member = classes.select("cid", "rep").join(roots.withColumnRenamed("node", "cid"), "cid")
    component = member.join(member.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("cid", "component_id")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "key", "rep", "weight").join(links, "cid", "left").join(component, "cid", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    full = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.col("vec_id").eqNullSafe(component).alias("kept"))
