"""Personal data: fixed patterns, and identifiers that contexts learned from their matches give away.

Bootstrapping: matches of the fixed patterns are the seeds. The two words before a word are its lexical pattern, the
word itself, without outer punctuation, is the instance; any word can be one. Patterns and instances form a graph that grows and is
scored in turns. A pattern's score is the share of its occurrences in the corpus that believed instances follow, and it needs
``support`` of them; seeds are believed. An instance's belief is the share of its own occurrences that follow good patterns,
each weighed with the pattern's score: a common word is never believed. Believed instances then nominate the
patterns they follow elsewhere, and so on for ``rounds``. Patterns that reach ``confidence`` discover (kind ``context``).

Each step is a pass over the texts that carries one filter of 2**24 bits of what is looked for, counts inside batches
first, and leaves out chance hits by a join; only patterns and instances above ``grow`` are spread out into edges, so that
edges stay near the number of seeds. Growth stops when a round finds no pattern.

Defined results: a null text counts as empty; repeated rows are separate; an empty table gives an empty result; other
columns are not read. Texts are read whole; work is linear in their length, up to a search among a text's spans
and words, also where one word goes on without end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.spans import Span, Taken, digest, joined
from packetloom.llm.text import LOWER, Words, buffers, chunks, mix
from packetloom.session import durable

KINDS = ("email", "ip", "card", "phone", "context")
# The base patterns. Possessive runs and the look-behind only spare repeated attempts.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: One linear test for whole batches, implied by every base kind; texts without a hit are clean.
SCREEN = "[0-9]|@"
EDGE = "()[]{}<>\"'`,;:!?.|*#"
EDGES = np.zeros(256, bool)
EDGES[list(EDGE.encode())] = True
FILTER_BITS = 24
_K = np.random.default_rng(11).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append((m.start(), 3, m.end()))
    return spans


class Contexts:
    """The word that a place is in, without outer punctuation, and the two words before it, however long they are."""

    def __init__(self, text: str):
        self.text = text
        self.words = [m.span() for m in WORD.finditer(text)]
        self.starts = [a for a, _ in self.words]

    def before(self, place: int) -> str:
        k = bisect_right(self.starts, place) - 1
        return " ".join(self.text[a:b] for a, b in self.words[k - 2 : k]) if k >= 2 else ""

    def at(self, places: list[int]) -> Iterator[tuple[int, str, str]]:
        """``number, pattern, instance`` of the first of the places in each word; a word is one occurrence, whatever is in it."""
        last = -1
        for number, place in sorted(enumerate(places), key=lambda x: x[1]):
            k = bisect_right(self.starts, place) - 1
            value = self.text[slice(*self.words[k])].strip(EDGE) if k > max(last, 1) else ""
            last = k
            if value:
                yield number, self.before(place), value


def pair_ids(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the neighbouring pairs of words of each text, and the first word of each pair."""
    h = words.hashes()
    first = np.flatnonzero(words.doc[:-1] == words.doc[1:]) if len(h) else np.zeros(0, np.int64)
    return mix(h[first] * _K[0] + h[first + 1] * _K[1]), first


class Followed:
    """Every word of some texts with two words before it: its pattern, its instance, and where it stands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(LOWER[data], offsets)
        pairs, first = pair_ids(words)
        use = first + 2 < words.first[words.doc[first] + 1] if len(first) else np.zeros(0, bool)
        self.pattern, self.word = pairs[use], first[use] + 2

    def trimmed(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, data = self.words.starts[of].copy(), self.words.ends[of].copy(), self.words.data
        for at, step in ((starts, 1), (ends, -1)):
            moving = np.arange(len(of))
            while len(moving):  # each round takes one mark off
                moving = moving[starts[moving] < ends[moving]]
                moving = moving[EDGES[data[at[moving] - (step < 0)]]]
                at[moving] += step
        return starts, ends

    def instances(self, of: np.ndarray) -> np.ndarray:
        """Hashes; 0 where only punctuation stands."""
        starts, ends = self.trimmed(of)
        return np.where(starts < ends, self.words.hashes(starts, ends), np.uint64(0))


def bits_of(keys: DataFrame, name: str) -> np.ndarray:
    """A filter of 2**24 bits of the ids in a column, at most 512 rows of 4 KB on their way."""
    bit = F.col(name).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    bits = np.zeros((1 << FILTER_BITS >> 15, 4096), np.uint8)
    for row in keys.groupBy(F.bitmap_bucket_number(bit).alias("g")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("b")).collect():
        bits[row.g - 1] = np.frombuffer(row.b, np.uint8)
    return bits.ravel()


def passes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = ids & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counted(docs: DataFrame, text_col: str, keys: DataFrame, by: str, spread: bool) -> DataFrame:
    """Over all texts, how often the patterns or instances (``by``) in ``keys`` occur: ``by, n``, or ``pattern, value, n``."""
    bits = bits_of(keys, by)
    names = ["pattern", "value"] if spread else [by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                seen = Followed(*buffers(batch.column(0)[lo:hi]))
                pattern, word = seen.pattern, seen.word
                if by == "pattern":
                    use = passes(pattern, bits)
                    pattern, word = pattern[use], word[use]
                value = seen.instances(word)
                use = value != 0
                if by == "value":
                    use &= passes(value, bits)
                rows = np.stack([{"pattern": pattern, "value": value}[c][use].view(np.int64) for c in names], axis=1)
                rows, n = np.unique(rows, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in rows.T], pa.array(n.astype(np.int64))], names=[*names, "n"])

    parts = docs.select(text_col).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return parts.groupBy(*names).agg(F.sum("n").alias("n")).join(keys.select(by).distinct(), by)


def extract(docs: DataFrame, id_col: str, text_col: str, patterns: np.ndarray | None = None, values: np.ndarray | None = None) -> DataFrame:
    """Base spans of each text and its occurrences: without filters those of base spans, the seeds; with filters of patterns and
    instances the words that pass both and that no base span touches."""
    schema = T.StructType.fromDDL(
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: int, kind: int, `end`: int>>, "
        "occurrences array<struct<pattern: long, value: long, whole: long, start: int, `end`: int>>")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *schema.fields])
    empty = digest("")
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    seen_type = pa.list_(pa.struct([("pattern", pa.int64()), ("value", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def hits(texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """``row, start, end, pattern, instance`` in order; places in code points."""
        for lo, hi in chunks(texts):
            data, offsets = buffers(texts[lo:hi])
            seen = Followed(data, offsets)
            use = passes(seen.pattern, patterns)
            pattern, word = seen.pattern[use], seen.word[use]
            value = seen.instances(word)
            use = (value != 0) & passes(value, values)
            order = np.argsort(word[use], kind="stable")
            pattern, word, value = pattern[use][order], word[use][order], value[use][order]
            starts, ends = seen.trimmed(word)
            before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points up to each byte
            docs_of = seen.words.doc[word]
            zero = before[offsets[docs_of]]
            yield from zip((docs_of + lo).tolist(), (before[starts] - zero).tolist(), (before[ends] - zero).tolist(),
                           pattern.view(np.int64).tolist(), value.view(np.int64).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = len(texts)
            n = [[0] * size for _ in range(4)]
            shas, base, seen = [empty] * size, [[] for _ in range(size)], [[] for _ in range(size)]
            found, contexts, instances, wholes = [], [], [], []
            hit = pc.fill_null(pc.match_substring_regex(texts, SCREEN), False)
            for i in pc.indices_nonzero(hit).to_pylist():
                text = texts[i].as_py()
                spans = base_spans(text)
                for _, k, _ in spans:
                    n[k][i] += 1
                shas[i] = digest(joined(spans, KINDS))
                base[i] = [{"start": a, "kind": k, "end": b} for a, k, b in sorted(spans)]
                if patterns is None and spans:
                    for number, context, value in Contexts(text).at([a for a, _, _ in spans]):
                        a, _, b = spans[number]
                        found.append((i, a, b))
                        contexts.append(context)
                        instances.append(value)
                        wholes.append(SPACE.sub("", text[a:b]))
            if found:
                data, offsets = buffers(pa.array(contexts))
                pairs, _ = pair_ids(Words(LOWER[data], offsets))
                value, whole = [Words(LOWER[d], o).hashes() for d, o in (buffers(pa.array(instances)), buffers(pa.array(wholes)))]
                for (i, a, b), p, v, w in zip(found, *[x.view(np.int64).tolist() for x in (pairs, value, whole)]):
                    seen[i].append({"pattern": p, "value": v, "whole": w, "start": a, "end": b})
            if patterns is not None:
                row, taken = -1, None
                for i, a, b, p, v in hits(texts):
                    if i != row:
                        row, taken = i, Taken([(x["start"], x["kind"], x["end"]) for x in base[i]])
                    if not taken.touches(a, b):
                        seen[i].append({"pattern": p, "value": v, "whole": v, "start": a, "end": b})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(shas), pa.array(base, base_type), pa.array(seen, seen_type)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def learned(docs: DataFrame, text_col: str, seeds: DataFrame, rounds: int = 2, support: int = 3, grow: float = 0.5) -> tuple[DataFrame, DataFrame] | None:
    """``pattern, score, support`` and ``value, belief`` after the last round that found patterns, from the seeds
    ``pattern, value, whole, n``; None if there are none."""
    known = seeds.groupBy("pattern").agg(F.sum("n").cast("double").alias("good"), F.countDistinct("whole").alias("support"))
    result = None
    for k in range(rounds):
        named = durable(known.filter(F.col("support") >= support))
        totals = counted(docs, text_col, named, "pattern", spread=False)
        patterns = durable(named.join(totals, "pattern").select(
            "pattern", "support", F.least(F.lit(1.0), F.col("good") / F.col("n")).alias("score")).filter(F.col("score") >= grow))
        if patterns.isEmpty():
            break
        edges = counted(docs, text_col, patterns, "pattern", spread=True).join(seeds.select("value").distinct(), "value", "left_anti")
        edges = durable(edges.join(patterns.select("pattern", "score"), "pattern"))
        reached = durable(edges.groupBy("value").agg(F.sum(F.col("n") * F.col("score")).alias("weight")))
        totals = counted(docs, text_col, reached, "value", spread=False)
        believed = durable(reached.join(totals, "value").select("value", (F.col("weight") / F.col("n")).alias("belief")).filter(F.col("belief") >= grow))
        result = patterns, believed
        if k + 1 < rounds:
            if believed.isEmpty():
                break
            more = counted(docs, text_col, believed, "value", spread=True).join(believed, "value")
            more = more.groupBy("pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("good"), F.count("*").alias("support"))
            known = known.unionByName(more).groupBy("pattern").agg(F.sum("good").alias("good"), F.sum("support").alias("support"))
            known = durable(known)
    return result


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.8, **growth) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans`` of every text."""
    seeds = durable(extract(docs, id_col, text_col).select(F.inline("occurrences")).groupBy("pattern", "value", "whole").agg(F.count("*").alias("n")))
    graph = learned(docs, text_col, seeds, **growth)
    nothing = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    if graph is None:
        rows = extract(docs, id_col, text_col).withColumn("new", nothing)
    else:
        good, believed = graph[0].filter(F.col("score") >= confidence).select("pattern"), graph[1].select("value")
        rows = extract(docs, id_col, text_col, bits_of(good, "pattern"), bits_of(believed, "value"))
        rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()))
        new = rows.select("uid", F.inline("occurrences")).join(good, "pattern").join(believed, "value").groupBy("uid").agg(
            F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new"))
        rows = rows.drop("occurrences").join(new, "uid", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("new", nothing)))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size(F.coalesce("new", nothing)).cast("long").alias("n_context"),
        "base_sha256", F.array_join(shown, ",").alias("spans"))
