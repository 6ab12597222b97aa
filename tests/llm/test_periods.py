"""Runs against brute force: small alphabets, nested and touching runs, planted stretches, long unbroken texts."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import periods, queries


def brute(words, least=24):
    """Every maximal stretch of every period, kept if no smaller period holds in it."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= max(least, 3 * q):
                found.setdefault((i, e + q), q)
            i = e + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def spelt(letters):
    return [c.encode() for c in letters]


def some_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.choice([0, 1, 5, 30, 100, 300, 500])
        alphabet = rng.choice(["a", "ab", "abc", "abcdefghij"])
        t = [rng.choice(alphabet) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):  # repeated pieces, some repeated pieces of repeated pieces
            if n > 10:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
                for i in range(a + p, min(n, a + rng.randint(2, 6) * p + rng.randrange(p))):
                    t[i] = t[i - p]
        yield t


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = list(some_texts(seed))
    found = periods.search([spelt(t) for t in texts])
    for t, f in zip(texts, found):
        assert [r for r in f if r[1] >= 24] == brute(t)


def test_structured_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [fib[-1], thue, "a" * 1000 + "b" * 1000, ("a" * 50 + "b") * 40, ("ab" * 30 + "c") * 20 + "ab" * 200, "abcdefg" * 3, "abcdefgh" * 3]
    for t, f in zip(texts, periods.search([spelt(t) for t in texts])):
        assert [r for r in f if r[1] >= 24] == brute(t), t[:40]


def test_colliding_hashes_change_nothing(monkeypatch):
    """All words hash alike: every proposal is extended too far and then mended word by word."""
    monkeypatch.setattr(periods, "mix", lambda h: h & periods.np.uint64(1))
    texts = list(some_texts(99))[:25]
    for t, f in zip(texts, periods.search([spelt(t) for t in texts])):
        assert [r for r in f if r[1] >= 24] == brute(t)


def test_long_texts_take_time_in_proportion():
    rng = random.Random(5)
    started = time.time()
    periods.search([[b"w"] * 300_000])
    periods.search([[b"%d" % rng.randrange(50) for _ in range(1000)] * 200])
    periods.search([[b"x" * 1_000_000]])
    assert time.time() - started < 20


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode(),
                                                   b" ".join(w for i, w in enumerate(words) if i not in drop))]
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, *sha)


def test_the_query_equals_brute_force(spark, docs_of, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(t) for t in some_texts(77)]
    rows = [(k, texts[k % len(texts)] if k % 3 else " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 200)))) for k in range(400)]
    rows += [(5, "twice the same row"), (5, "twice the same row"), (900, None), (901, ""), (902, " \n\t\x0b\x0c\r "), (None, "ab " * 40),
             (903, "    " * 30), (904, "a\x85b " * 30 + "end"), (905, "line\n" * 40)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted((expected(i, t) for i, t, *_ in rows), key=key)


def test_an_empty_table_and_clashing_columns(spark, docs_of, tmp_path):
    docs = docs_of([(1, "a b " * 20)]).withColumn("runs", F.lit(3)).withColumn("start", F.lit("x"))
    assert periods.periodic_runs(docs).first().runs == [(0, 40, 2)]
    assert periods.periodic_runs(docs.limit(0)).count() == 0
