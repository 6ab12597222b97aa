"""A trie of conversation prefixes, by halving depths (van Emde Boas recursion).

Sequences are cut at half depth; the cut prefixes are named; the upper trie and the forests below the cuts, one for each
name, are built in the same way, all at the same time; and totals are grafted upward from cut to cut.

* Naming. Blocks of ``2^j`` turns are named bottom-up from their halves. Top-down, a prefix that ends in the lower half
  of a block is named by the name of the prefix before the block and that of the block's upper half. Names are 128-bit
  digests of contents, so forests need no numbering round. Six halvings take place inside a row of up to ``WIDTH``
  turns; the rows of a long conversation are the turns of the next level, so that no task ever holds a conversation and
  a conversation of ``n`` turns takes ``log n / log WIDTH`` levels.
* A node is the set of equal names: counts and the smallest member are one aggregate with map-side combination. Its rows
  along the smallest member lead to its ancestors.
* Grafting. Subtree totals inside blocks of ``u`` depths are known (``u = 1`` first); the roots of the blocks, seven of eight
  of them below a cut of the ``8u`` block, add theirs to their ancestors in it: three halvings a round. A root at
  depth ``d`` has fewer than ``8u`` ancestors there and only one depth in ``u`` holds roots, so a round makes
  four rows a node on average.

A node may have a third of all conversations as members, children or ends. Members and totals are sums; the smallest
members of parents with many children (over 1 in 1000 of all, so fewer than 1000 parents) are broadcast; the ids that
end at a node are sorted by range and joined to pieces of text before one task digests the pieces as a stream.

Defined results: null roles and texts are empty; a turn without a conversation id belongs to none and is left out; turns
of equal number follow each other by the digest of role and text; repeated rows are turns of their own; very long texts
count by their digest; an empty table has no nodes, not even a root. Columns other than the four read may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import OrderedGroups
from packetloom.session import durable

#: Turns in a row: six halvings.
WIDTH = 64
#: Depths that one round of grafting joins: three halvings.
FAN = 8
#: Ids in a piece of text before it is digested.
PIECE = 4096
HEAVY = 1000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _name(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``token, bytes``: each conversation's turns in order, as digests."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        _name(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("token"),
        F.octet_length(text).cast("long").alias("bytes"))
    return OrderedGroups(rows, ["conv_id"], ["turn", "token"], True).numbered("pos").df.drop("turn")


def regrown(own: DataFrame, shared: Column, group: int = 5) -> DataFrame:
    """Every conversation ``c`` with its first ``shared`` turns (a column of ``conv_id``, 8 at most) replaced by those of conversation
    ``c - c % group``: ``conv_id, depth`` (from 1), ``token, bytes``; a row without a token for a conversation left without turns."""
    own = durable(own)
    convs = durable(own.select("conv_id").distinct())
    first = own.filter((F.col("conv_id") % group == 0) & (F.col("pos") <= 8))
    near = F.explode(F.sequence(F.col("conv_id") - (group - 1), F.col("conv_id") + (group - 1)))
    lent = first.select(F.col("conv_id").alias("_from"), near.alias("conv_id"), "pos", "token", "bytes")
    lent = lent.filter(F.col("conv_id") - F.col("conv_id") % group == F.col("_from")).join(convs, "conv_id")
    kept = own.select("conv_id", F.lit(1).alias("_own"), "pos", "token", "bytes").filter(F.col("pos") > shared)
    lent = lent.select("conv_id", F.lit(0).alias("_own"), "pos", "token", "bytes").filter(F.col("pos") <= shared)
    both = OrderedGroups(kept.unionByName(lent), ["conv_id"], ["_own", "pos"], True).numbered("depth").df
    both = both.select("conv_id", "depth", "token", "bytes")
    none = convs.join(both.select("conv_id").distinct(), "conv_id", "left_anti")
    return both.unionByName(none.select("conv_id", *[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in ("depth", "token", "bytes")]))


def _named(items: DataFrame) -> DataFrame:
    """``conv_id, x, name, bytes``: the name of the first ``x`` items of each sequence, for ``x`` up to its length.

    ``items``: ``conv_id, x`` (from 0 without gaps), ``token, bytes``; the last of a sequence has no token.
    """
    top = items.agg(F.max("x")).first()[0]
    cells = F.array_sort(F.collect_list(F.struct(F.col("x").alias("x"), F.col("token").alias("token"), F.col("bytes").alias("bytes"))))
    blocks = items.groupBy("conv_id", F.floor(F.col("x") / WIDTH).alias("_block")).agg(cells.alias("_cells"))  # WIDTH at most
    blocks = blocks.withColumn("_0", F.transform("_cells", lambda c: c["token"]))
    levels = WIDTH.bit_length() - 1
    for j in range(levels):
        pairs = F.floor(F.size(f"_{j}") / 2).cast("int")
        both = F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: _name(F.get(f"_{j}", 2 * i), F.get(f"_{j}", 2 * i + 1)))  # noqa: B023
        blocks = blocks.withColumn(f"_{j + 1}", F.when(pairs > 0, both).otherwise(F.array().cast("array<binary>")))
    if top < WIDTH:
        blocks = blocks.withColumn("_before", F.lit(b""))
    else:
        blocks = durable(blocks)
        upper = blocks.select("conv_id", F.col("_block").alias("x"), F.get(f"_{levels}", F.lit(0)).alias("token"), F.lit(0).cast("long").alias("bytes"))
        names = _named(upper).select("conv_id", F.col("x").alias("_block"), F.col("name").alias("_before"))
        blocks = blocks.join(names, ["conv_id", "_block"])
    blocks = blocks.withColumn("_names", F.array("_before"))
    for j in reversed(range(levels)):  # the lower halves are named by the cut prefix and the upper half
        pair = F.transform("_names", lambda name, i: F.array(name, _name(name, F.get(f"_{j}", 2 * i))))  # noqa: B023
        blocks = blocks.withColumn("_names", F.slice(F.flatten(pair), 1, F.ceil(F.size("_cells") / (1 << j)).cast("int")))
    out = blocks.select("conv_id", F.explode(F.arrays_zip("_cells", "_names")).alias("_c"))
    return out.select("conv_id", "_c._cells.x", F.col("_c._names").alias("name"), "_c._cells.bytes")


def _digests(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the comma-joined ids ``conv_id`` of each name, in rising order."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, out = None, [], []

        def full():
            if ids:
                out.append((name, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != name or len(ids) == PIECE:
                    full()
                    name, ids = n, []
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "part"), o)) for o in out], piece_type)
                out.clear()
        full()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "part"), o)) for o in out], piece_type)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []
        for batch in batches:
            for n, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != name:
                    if state:
                        out.append({"name": name, "ends_sha256": state.hexdigest()})
                    name, state = n, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            yield pa.RecordBatch.from_pylist(out, digest_type)
            out = []
        if state:
            yield pa.RecordBatch.from_pylist([{"name": name, "ends_sha256": state.hexdigest()}], digest_type)

    piece_type = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("part", pa.string())])
    digest_type = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])
    cut = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    parts = cut.select("name", "conv_id").mapInArrow(pieces, "name binary, first bigint, part string")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digest, "name binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``sequences``: ``conv_id, depth`` (from 1 without gaps), ``token, bytes``, and a row with null depth for a sequence without turns.
    """
    count = sequences.groupBy("conv_id").agg(F.count("depth").alias("x"))
    ends = count.select("conv_id", "x", F.lit(None).cast("binary").alias("token"), F.lit(None).cast("long").alias("bytes"))
    items = sequences.filter("depth is not null").select("conv_id", (F.col("depth") - 1).alias("x"), "token", "bytes").unionByName(ends)
    items = durable(items)
    if items.isEmpty():
        return items.sparkSession.range(0).select(
            *[F.lit(None).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.lit("").alias("ends_sha256"))
    prefixes = durable(_named(items))  # bytes: of the turn that follows the prefix, null at the end
    deepest = prefixes.agg(F.max("x")).first()[0]

    groups = prefixes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("x").alias("depth"), F.count(F.lit(1)).alias("n_convs"))
    above = prefixes.select("conv_id", (F.col("x") + 1).alias("depth"), F.col("name").alias("parent"), F.col("bytes").alias("last_bytes"))
    nodes = durable(groups.join(above, ["conv_id", "depth"], "left"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = durable(nodes.join(children, "name", "left").fillna(0, ["n_children"]))

    saved = (F.col("n_convs") - 1) * F.coalesce("last_bytes", F.lit(0))
    totals = nodes.select("name", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    unit = 1
    while unit <= deepest:
        within = F.col("depth") % (FAN * unit)
        roots = totals.filter((F.col("depth") % unit == 0) & (within > 0))
        paths = roots.select("conv_id", F.explode(F.sequence(F.col("depth") - within, F.col("depth") - 1)).alias("x"), "n_leaves", "saved_tokens")
        grafts = paths.join(prefixes.select("conv_id", "x", "name"), ["conv_id", "x"]).groupBy("name").agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        totals = durable(totals.join(grafts, "name", "left").select(
            "name", "conv_id", "depth", (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens")))
        unit *= FAN

    known = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * HEAVY > nodes.count()).alias("_heavy"))
    heavy, light = (known.filter(w).drop("_heavy") for w in ("_heavy", "not _heavy"))
    below = nodes.filter("parent is not null")
    with_parent = below.join(F.broadcast(heavy), "parent").unionByName(
        below.join(F.broadcast(heavy), "parent", "left_anti").join(light, "parent").select("parent", *[c for c in below.columns if c != "parent"], "parent_conv_id"))
    root = nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    digests = _digests(prefixes.filter("bytes is null").select("name", "conv_id"))
    out = with_parent.unionByName(root).join(totals.drop("conv_id", "depth"), "name").join(digests, "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
