"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Every source becomes a stream of words: its documents in a fixed pseudo-random order. The stream is
cut into equal blocks. Slot ``i`` of the mix maps the golden-ratio point ``frac(i * phi)`` through the
cumulative source weights; slots are ranked per source, and rank ``r`` takes block ``r`` of its
source's stream, which wraps around up to ``repeats`` times.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its
own, ordered last; repeated rows are separate documents; an empty table gives an empty mix. Columns
besides id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.session import durable

WORD = r"[^\x20\x09-\x0D]+"
PHI32 = 2654435769  # round(2**32 / golden ratio)
SPAN = 1 << 32
BIN = 1 << 20
RANK_CHUNK = 1 << 16


def source_key(source: Column) -> Column:
    """A string that sorts sources by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def golden_point(i: Column) -> Column:
    """``frac(i * phi)`` scaled to 2**32, in integers that do not overflow."""
    low, half = i % (1 << 31), (i / (1 << 31)).cast("long") % 2
    return (low * F.lit(PHI32).cast("long") + half * (1 << 31)) % SPAN


def sized_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """``doc_id, source, skey, size, key``: number of words and the shuffle key of each document."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))


def water_fill(sizes: DataFrame, weights=(5, 2, 1), share=1.5, repeats=2) -> DataFrame:
    """``skey, source_size, target``: ``share`` of all words dealt by weight, each target at most
    ``repeats`` times its source; what is cut off is dealt again by weight until none is above.

    That fixed point is ``min(cap, level * weight)``: with sources ordered by cap / weight, a source is
    cut off exactly if the level that the rest would have reaches its ratio. One row per source.
    """
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.withColumn("w", F.element_at(pattern, ((F.row_number().over(W.orderBy("skey")) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * repeats)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "skey")
    s = s.withColumn("caps", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = (F.col("budget") - F.coalesce("caps", F.lit(0))) / F.col("rest_w")
    s = s.withColumn("level_at", F.when(level < F.col("ratio"), level))
    s = s.withColumn("level", F.first("level_at", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return s.select("skey", "source_size", target.alias("target"))


def stream_positions(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each document starts in its source's shuffled stream, and the size of every source.

    The running sum is per (source, slice of the shuffle key), slices then start after one another, so a
    source with a third of all rows is cut into 4096 windows.
    """
    sized = sized.withColumn("slice", F.substring("key", 1, 3))
    sums = sized.groupBy("skey", "slice").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("skey").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("skey", "slice", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("size").over(W.partitionBy("skey", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    placed = sized.withColumn("inside", inside - F.col("size")).join(offsets, ["skey", "slice"])
    placed = placed.select("doc_id", "source", "skey", "size", "key", (F.col("offset") + F.col("inside")).alias("start"))
    return placed, sums.groupBy("skey").agg(F.sum("words").alias("source_size"))


def schedule(targets: DataFrame) -> DataFrame:
    """``slot, skey, rank`` for sources with ``blocks`` each: golden-ratio points through the cumulative
    shares. A rank that the points do not reach is appended after the last slot, one beyond the need is left out."""
    spark = targets.sparkSession
    total = targets.agg(F.sum("blocks")).first()[0] or 0
    upto = F.sum("blocks").over(W.orderBy("skey").rowsBetween(W.unboundedPreceding, 0))
    edge = lambda c: F.floor(c / F.lit(float(max(total, 1))) * SPAN).cast("long")
    cuts = targets.withColumn("upto", upto).select(
        "skey", "blocks", edge(F.col("upto") - F.col("blocks")).alias("lo"), edge(F.col("upto")).alias("hi")).filter("hi > lo")
    bins = cuts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))))
    slots = spark.range(total).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    slots = slots.withColumn("bin", F.floor(F.col("point") / BIN)).join(bins, "bin").filter("point >= lo and point < hi")
    slots = slots.select("slot", "skey", "blocks", F.floor(F.col("slot") / RANK_CHUNK).alias("chunk"))
    counts = slots.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("skey").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    counts = durable(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    inside = F.row_number().over(W.partitionBy("skey", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(counts, ["skey", "chunk"]).select(
        "slot", "skey", (F.col("before") + F.col("inside")).alias("rank"), "blocks").filter("rank < blocks").drop("blocks")
    reached = counts.groupBy("skey").agg(F.sum("n").alias("reached"))
    short = targets.join(reached, "skey", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).filter("blocks > reached")
    late = F.sum(F.col("blocks") - F.col("reached")).over(W.orderBy("skey").rowsBetween(W.unboundedPreceding, -1))
    appended = short.withColumn("late", F.coalesce(late, F.lit(0))).withColumn("rank", F.explode(F.expr("sequence(reached, blocks - 1)"))).select(
        (F.lit(total) + F.col("late") + F.col("rank") - F.col("reached")).alias("slot"), "skey", "rank")
    return ranked.unionByName(appended)


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share=1.5, repeats=2, block_words=256, **columns) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents with their source's size and target.

    The mix has one row per slot and document part: ``slot, skey, rank, epoch, doc_id, key, start, part_start,
    part_words``; ``part_start`` counts words inside the document. Each source takes ``floor(target)`` words.
    """
    sized = durable(sized_documents(docs, **columns))
    placed, sizes = stream_positions(sized)
    targets = water_fill(sizes, weights, share, repeats).withColumn("need", F.floor("target").cast("long"))
    targets = durable(targets.withColumn("blocks", F.ceil(F.col("need") / block_words).cast("long")))
    placed = durable(placed.join(targets, "skey"))
    copies = placed.filter("size > 0 and need > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, (need - 1) div source_size)")))
    copies = copies.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("start"))
    copies = copies.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("need"))).filter("hi > lo")
    parts = copies.withColumn("rank", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})")))
    first = F.greatest(F.col("lo"), F.col("rank") * block_words)
    parts = parts.select(
        "skey", "rank", "epoch", "doc_id", "key", "size", "start", (first - F.col("lo")).alias("part_start"),
        (F.least(F.col("hi"), (F.col("rank") + 1) * block_words) - first).alias("part_words"))
    return schedule(targets.select("skey", "blocks")).join(parts, ["skey", "rank"]), placed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, what the mix takes of it."""
    mix, placed = mix_sources(docs, **options)
    row = ["skey", "doc_id", "key", "size", "start"]
    taken = mix.select(*row, "part_words").unionByName(placed.filter("size > 0").select(*row, F.lit(0).cast("long").alias("part_words")))
    taken = taken.groupBy(*row).agg(F.sum("part_words").alias("taken"))
    totals = placed.groupBy("skey").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    empty = placed.filter("size = 0").select("skey", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.select("skey", "doc_id", "size", "taken").unionByName(empty).join(totals, "skey").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, in whole documents: the words taken over its size, rounded.
    Rows that share an id get the largest number among them; empty texts, of which there is nothing to take, stay once."""
    taken = taken_words(docs, id_col=id_col, **options)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    copies = taken.groupBy(F.col("doc_id").alias("_id")).agg(F.max(copies).alias("_copies")).filter("_copies > 0")
    found = docs.join(copies, F.col(id_col).eqNullSafe(F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return found.select(*[F.col(c) for c in docs.columns])
