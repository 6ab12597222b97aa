"""The prefix trie against dictionaries of prefixes."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import queries, trie

SCHEMA = "conv_id long, turn int, role string, text string, token int, depth string"


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            token = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), token, (role, text)))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]  # the remainder has the sign of c, as in SQL
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    below, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            below[p[:-1]] = below.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in below)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), below.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items())


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple((v is None, v) for v in r))


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    return result(queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path)))


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("longest", [9, 300])
def test_the_query_equals_brute_force(spark, tmp_path, longest):
    rng = random.Random(longest)
    rows = []
    common = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é", ""])) for _ in range(longest)]
    for c in range(150):
        n = rng.choice([1, 2, 5, 8, longest, longest, rng.randint(1, longest)])
        keep = rng.choice([0, n // 2, n, n])
        for k in range(n):
            role, text = common[k] if k < keep else (rng.choice(["user", None]), rng.choice(["a", "ccc", None]))
            rows.append((c if c % 11 else c + 1000, k, role, text))
    rng.shuffle(rows)
    assert run(spark, tmp_path, rows) == by_key(expected(rows))


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(5, None, "user", "first"), (5, 1, None, None), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (6, 3, "user", ""), (6, 2, "", "user"),
            (None, 1, "user", "nobody's"), (-7, 1, "a", "b"), (-5, 1, "a", "c"), (7, 1, "u", "x" * 500_000), (8, 1, "u", "x" * 500_000), (12, 4, "ser", "tie")]
    assert run(spark, tmp_path, rows) == by_key(expected(rows))


def test_a_very_long_and_a_very_common_conversation(spark, tmp_path):
    rows = [(3, k, "user", "x%d" % (k % 7)) for k in range(500)] + [(c, k, "user", "same") for c in range(10, 400) for k in range(2)]
    assert run(spark, tmp_path, rows) == by_key(expected(rows))


def test_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_names_do_not_depend_on_the_row_width(spark, monkeypatch):
    items = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") + 1).alias("depth"),
                                    F.col("id").cast("string").cast("binary").alias("token"), F.lit(1).cast("long").alias("bytes"))
    plain = result(trie.prefix_trie(items))
    monkeypatch.setattr(trie, "WIDTH", 8)
    assert result(trie.prefix_trie(items)) == plain
    assert [r[5] for r in plain] == [1] * 701
