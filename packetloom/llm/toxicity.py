"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

1. Lexicon voters (words, beginnings and ends of words) are induced from a bounded sample of labelled rows; two
   pattern voters look at shouting. 2. The votes of all documents are counted per vote pattern. 3. Expectation
   maximization over these counts estimates how often each voter fires on toxic and on clean texts, and how far
   voters repeat each other; repeated votes are discounted. 4. A logistic regression on the lexicon's features is
   fitted to the posterior labels of the sample and scores every text.

Labels are learned from rows outside the held-out quarter (crc32 of the id modulo 4 is 2) alone. Scores depend on the
text alone.

Defined results: a null text counts as empty and gets the score of a text without features; repeated rows get equal
scores; a null label is no label, several labels of an id count as toxic if one is; without labels of both kinds all
scores are the prior 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.text import Words, buffers, chunks, mix
from packetloom.session import durable

BUCKETS = 1 << 20
#: (kind, bytes): whole words, beginnings and ends.
PARTS = [("word", 0), ("head", 4), ("head", 5), ("head", 6), ("tail", 4), ("tail", 5)]
_SALT = mix(np.arange(1, len(PARTS) + 1, dtype=np.uint64))
_LETTERS = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _LETTERS[_b] = 0x20


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every part of every word of some texts, kind by kind."""
    data, offsets = buffers(pc.utf8_lower(texts))
    words = Words(_LETTERS[data], offsets)
    long = words.ends - words.starts
    for (kind, size), salt in zip(PARTS, _SALT):
        use = np.flatnonzero(long > size)
        starts, ends = words.starts[use], words.ends[use]
        if kind == "head":
            ends = starts + size
        elif kind == "tail":
            starts = ends - size
        h = mix(words.hashes(starts, ends) ^ salt)
        yield words.doc[use], (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def hits(texts: pa.Array, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs of the features that have a slot; ``slots`` gives it by bucket, -1 for none."""
    found = []
    for doc, bucket in features(texts):
        slot = slots[bucket]
        use = slot >= 0
        found.append(doc[use] << 32 | slot[use])
    pairs = np.unique(np.concatenate(found))
    return pairs >> 32, pairs & 0xFFFFFFFF


def shouting(texts: pa.Array) -> np.ndarray:
    """Two pattern votes per text: many exclamation marks, many capitals."""
    data, offsets = buffers(texts)
    size = np.diff(offsets)
    count = lambda flag: np.diff(np.r_[0, np.cumsum(flag)][offsets])
    marks, capitals = count(data == 0x21), count((data >= 0x41) & (data <= 0x5A))
    return np.stack([marks * 50 > np.maximum(size, 1), capitals * 4 > np.maximum(size, 1)], axis=1)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def lists(offsets_of: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    ends = np.searchsorted(offsets_of, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``label, text`` of at most ``rows`` labelled documents outside the held-out quarter, chosen by a hash of the id."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("label"))
    known = known.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id").select("label", "text")  # at most ``rows`` rows


def sample_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sample on the driver, which its bound allows: labels, and (row, bucket) for buckets of several toxic texts."""

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                pairs = np.unique(np.concatenate([d << 32 | b for d, b in features(batch.column(0)[lo:hi])]))
                bucket, n = np.unique(pairs & 0xFFFFFFFF, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

    frequent = sample.filter("label = 1").select("text").mapInArrow(toxic, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter("n >= 5")
    buckets = np.sort(np.array([r.bucket for r in frequent.select("bucket").collect()], np.int64))
    slots = np.full(BUCKETS, -1, np.int64)
    slots[buckets] = np.arange(len(buckets))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                doc, slot = hits(batch.column(1)[lo:hi], slots)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists(doc, slot, hi - lo)], names=["label", "slots"])

    table = sample.select(F.col("label").cast("int"), "text").mapInArrow(find, "label int, slots array<int>").toArrow().combine_chunks()
    label = table["label"].to_numpy()
    column = pa.concat_arrays(table["slots"].chunks) if table.num_rows else pa.array([], pa.list_(pa.int32()))
    n = np.diff(column.offsets.to_numpy()) if len(label) else np.zeros(0, np.int64)
    return label, np.repeat(np.arange(len(label)), n), buckets[column.flatten().to_numpy()] if len(label) else np.zeros(0, np.int64)


def induce(label: np.ndarray, row: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """Buckets whose features speak for toxicity, the surest first."""
    pos = np.bincount(bucket[label[row] == 1], minlength=BUCKETS)
    neg = np.bincount(bucket[label[row] == 0], minlength=BUCKETS)
    p, n = (label == 1).sum(), (label == 0).sum()
    odds = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((neg + 0.5) / (n - neg + 0.5))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (p - pos + 0.5) + 1 / (neg + 0.5) + 1 / (n - neg + 0.5))
    order = np.argsort(-z, kind="stable")[:most]
    return order[(z[order] > 3) & (pos[order] >= 5) & (odds[order] > 1.5)]


class LabelModel:
    """Firing rates of the voters on toxic and clean texts, and the weight that their correlations leave them."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, prior: float):
        self.gold = (toxic, clean, prior)
        self.toxic, self.clean, self.prior, self.weight = toxic, clean, prior, np.ones(len(toxic))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        a, b = np.clip(self.toxic, 1e-4, 1 - 1e-4), np.clip(self.clean, 1e-5, 1 - 1e-4)
        fire, rest = np.log(a / b) * self.weight, np.log((1 - a) / (1 - b)) * self.weight
        prior = np.clip(self.prior, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(votes @ (fire - rest) + rest.sum() + np.log(prior / (1 - prior)), -50, 50)))

    def sums(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the next estimate needs of some vote patterns: numbers, first and second moments of both classes."""
        post = self.posterior(votes)
        t, c = (votes * (n * post)[:, None]), (votes * (n * (1 - post))[:, None])
        return np.concatenate([[n @ post, n @ (1 - post)], t.sum(0), c.sum(0), (t.T @ votes).ravel(), (c.T @ votes).ravel()])

    def update(self, sums: np.ndarray, trust: float = 0.5) -> None:
        """New rates; those of the labelled sample count for a share of ``trust``."""
        j = len(self.toxic)
        nt, nc = sums[0] + 1e-9, sums[1] + 1e-9
        t, c = sums[2 : 2 + j] / nt, sums[2 + j : 2 + 2 * j] / nc
        both = sums[2 + 2 * j :].reshape(2, j, j)
        repeated = np.zeros((j, j))
        for rate, n, m in ((t, nt, both[0]), (c, nc, both[1])):
            spread = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate))) + 1e-12
            repeated = np.maximum(repeated, np.clip((m / n - np.outer(rate, rate)) / spread, 0, 1))
        np.fill_diagonal(repeated, 0)
        self.weight = 1 / (1 + repeated.sum(1))
        gold_t, gold_c, gold_p = self.gold
        self.toxic, self.clean = trust * gold_t + (1 - trust) * t, trust * gold_c + (1 - trust) * c
        self.prior = trust * gold_p + (1 - trust) * nt / (nt + nc)


def unpack(votes: np.ndarray, j: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(j)) & 1).astype(np.float64)


def fit_label_model(model: LabelModel, patterns: DataFrame, j: int, rounds: int = 4) -> None:
    """Expectation maximization over ``votes, n``; a sum of fixed size comes back from each task."""
    for _ in range(rounds):
        def add(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if batch.num_rows:
                    total = total + model.sums(unpack(batch.column(0).to_numpy(), j), batch.column(1).to_numpy().astype(float))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

        rows = patterns.mapInArrow(add, "sums array<double>").collect()
        if not rows:
            return
        model.update(np.sum([r.sums for r in rows], axis=0))


def fit_linear(row: np.ndarray, slot: np.ndarray, target: np.ndarray, width: int, ridge: float = 2e-4, steps: int = 500) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the constant."""
    n = len(target)
    x = np.zeros((n, width + 1), np.float32)
    x[row, slot] = 1
    x[:, width] = 1
    v = np.ones(width + 1, np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (x.T @ (x @ v))) / n + ridge)
    w = look = np.zeros(width + 1, np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        grad = x.T @ (p - target.astype(np.float32)) / n + ridge * np.r_[look[:-1], 0].astype(np.float32)
        step = look - rate * grad
        look = step + k / (k + 3) * (step - w)
        w = step
    return w.astype(np.float64)


def lexicon_votes(docs: DataFrame, slots: np.ndarray, lexicon: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, votes, hits`` of every document: the voters that fire as bits, and the slots of its features."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("votes", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType(), False))])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                texts = pc.fill_null(batch.column(1)[lo:hi], "")
                doc, slot = hits(texts, slots)
                votes = (shouting(texts) << np.array([lexicon, lexicon + 1])).sum(1).astype(np.int64)
                fired = slot < lexicon
                np.bitwise_or.at(votes, doc[fired], np.int64(1) << slot[fired])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(votes), lists(doc, slot, hi - lo)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(vote, schema)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, vocabulary: int = 1024,
           voters: int = 48) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The slots and weights of the classifier, and the votes of all documents, which the label model was estimated on.
    At most ``sample_rows`` labelled rows are fitted on."""
    label, row, bucket = sample_features(labelled_sample(docs, labels, id_col, text_col, sample_rows))
    chosen = induce(label, row, bucket, vocabulary) if len(set(label.tolist())) == 2 else np.zeros(0, np.int64)
    slots = np.full(BUCKETS, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    lexicon = min(voters, len(chosen))
    j = lexicon + 2
    voted = durable(lexicon_votes(docs, slots, lexicon, id_col, text_col))
    if not len(chosen):
        return slots, np.zeros(1), voted
    slot = slots[bucket]
    row, slot = row[slot >= 0], slot[slot >= 0]
    fired = np.zeros((len(label), j))
    fired[row[slot < lexicon], slot[slot < lexicon]] = 1
    rate = lambda y: (fired[label == y].sum(0) + 0.1) / ((label == y).sum() + 1)
    model = LabelModel(rate(1), rate(0), float((label == 1).mean()))
    fit_label_model(model, durable(voted.groupBy("votes").agg(F.count("*").alias("n"))), j)
    post = np.clip(model.posterior(fired), 1e-6, 1 - 1e-6)
    # the annotation is one more voter, right in 98 of 100 cases
    target = 1 / (1 + np.exp(-(np.log(post / (1 - post)) + np.where(label == 1, 1, -1) * np.log(49))))
    return slots, fit_linear(row, slot, target, len(chosen)), voted


def scores(ends: np.ndarray, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of texts whose slots are ``found[ends[i]:ends[i + 1]]``."""
    values = np.r_[0.0, np.cumsum(weights[found])]
    z = values[ends[1:]] - values[ends[:-1]] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50))) if len(weights) > 1 else np.zeros(len(z))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    _, weights, voted = fitted(docs, labels, id_col, text_col, **fit)
    out = T.StructType([voted.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1)
            ends = found.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(ends - ends[0], found.flatten().to_numpy(), weights))], names=out.names)

    scored = voted.select("doc_id", "hits").mapInArrow(score, out)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; texts are scored where they are, no row moves."""
    slots, weights, _ = fitted(docs, labels, id_col, text_col, **fit)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        column = pc.fill_null(texts, "")
        parts = [np.zeros(0)]
        for lo, hi in chunks(column):
            doc, slot = hits(column[lo:hi], slots)
            parts.append(scores(np.searchsorted(doc, np.arange(hi - lo + 1)), slot, weights))
        return pa.array(np.concatenate(parts))

    return docs.filter(score(F.col(text_col)) < threshold)
