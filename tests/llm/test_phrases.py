"""Phrase fingerprints against a plain parser and plain sets."""

import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from packetloom.llm import phrases, queries
from packetloom.llm.periods import _ODD
from packetloom.llm.text import mix

MASK = 2**64 - 1


def phrase_set(data):
    known, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            start = end
    return known


def low_hash(phrase):
    total = sum(int(mix(np.array([b], np.uint64) + _ODD)[0]) * pow(int(_ODD), i, 2**64) for i, b in enumerate(phrase)) & MASK
    return int(mix(np.array([total], np.uint64))[0]) >> 32


def sketch(data, size):
    return sorted({low_hash(p) for p in phrase_set(data)})[:size]


def near(a, b, size):
    union = sorted(set(a) | set(b))[:size]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def expected(rows, size):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = (t[: len(t) - half] + nxt[:half]).encode()
        a, b, c = sketch(t.encode(), size), sketch(edited, size), sketch(nxt.encode(), size)
        hexed = ["".join(f"{v:08x}" for v in s) for s in (a, b)]
        out.append((i, len(t), hashlib.sha256(edited).hexdigest(), *hexed, round(near(a, b, size), 12), round(near(a, c, size), 12)))
    return out


def some_rows(n, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé日𝄞") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = [(3 * k - 50, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 9, 40, 120])))) for k in range(n)]
    rows += [(7 * n, None), (7 * n + 1, ""), (7 * n + 2, "x"), (10, "tie b"), (10, "tie a"), (10, "tie a"), (None, "no id"), (None, "aaaaaaaaaaaaaaaaa" * 9)]
    rng.shuffle(rows)
    return rows


def result(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect()]


def test_every_column_equals_the_plain_version(spark, docs_of):
    rows = some_rows(120)
    got = result(phrases.edit_likeness(docs_of(rows).repartition(7), size=16))
    assert sorted(got, key=repr) == sorted(expected(rows, 16), key=repr)


def test_few_rows(spark, docs_of):
    for rows in ([(1, "only one row here")], [(2, "ab"), (1, "abab ab")], [(None, "x y z")], [(5, ""), (5, None)], [(4, "same"), (4, "same"), (4, "same")]):
        assert sorted(result(phrases.edit_likeness(docs_of(rows), size=8)), key=repr) == sorted(expected(rows, 8), key=repr)


def test_the_query(spark, docs_of, tmp_path):
    rows = some_rows(60, seed=9)
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_phrase_fingerprint"](spark, str(tmp_path))
    assert sorted(result(got), key=repr) == sorted(expected(rows, phrases.SIZE), key=repr)


def test_fingerprints_and_likeness_as_columns(spark, docs_of):
    rows = some_rows(40, seed=2)
    docs = docs_of(rows).withColumn("fingerprint", F.lit(1)).withColumn("_part", F.lit("x"))
    prints = phrases.fingerprints(docs, size=32)
    want = sorted(("".join(f"{v:08x}" for v in sketch((t or "").encode(), 32)), len(phrase_set((t or "").encode()))) for _, t, *_ in rows)
    assert sorted((r.fingerprint, r.n_phrases) for r in prints.collect()) == want
    other = prints.select(F.lit(prints.filter("doc_id = 40").first().fingerprint).alias("two"), F.col("fingerprint").alias("one"))
    for r in other.select("one", "two", phrases.likeness(32)("one", "two").alias("near")).collect():
        a, b = ([int(s[i : i + 8], 16) for i in range(0, len(s), 8)] for s in (r.one, r.two))
        assert abs(r.near - near(a, b, 32)) < 1e-12
    assert prints.select(phrases.likeness()("fingerprint", F.lit(None).cast("string")).alias("n")).filter("n is not null").isEmpty()
    assert phrases.fingerprints(docs.limit(0)).count() == phrases.edit_likeness(docs.limit(0)).count() == 0


def test_estimates_come_near_the_phrase_sets():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(1500)).encode() for _ in range(4)]
    texts += [t[: len(t) * 3 // 4] + texts[0][:2000] for t in texts]
    ends = [[] for _ in texts]
    for t, e in zip(texts, ends):
        phrases.parse(t, {}, 0, e)
    flat, at = phrases.sketches(texts, ends)
    n = len(texts) // 2
    got = phrases.alike(flat[: at[n]], at[: n + 1], flat[at[n] :], at[n:] - at[n])
    for k in range(n):
        a, b = phrase_set(texts[k]), phrase_set(texts[n + k])
        assert abs(got[k] - len(a & b) / len(a | b)) < 0.15


def test_long_unbroken_texts():
    started = time.time()
    for text in (b"a" * 3_000_000, bytes(random.Random(2).randrange(33, 127) for _ in range(1_000_000))):
        ends = []
        phrases.parse(text, {}, 0, ends)
        phrases.sketches([text], [ends])
    assert time.time() - started < 10
