"""One unbroken line of a megabyte through every per-text operator, and the linear line rules against their plain forms."""

import random
import string
import time

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import packing, pii, quality, secrets
from packetloom.llm.spans import Taken
from packetloom.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(4)
LONG = {
    "tokens": "Token" * 200_000,
    "base64": "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(1_000_000)),
    "addresses": "1.1.1.1," * 125_000,
    "letter": "a" * 1_000_000,
    "shouted": "A" * 1_000_000,
    "symbols": "#" * 1_000_000,
    "points": "A." * 500_000,
    "menu": " | x" * 250_000,
    "at": "a@" * 500_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_a_megabyte_without_a_break(spark, docs_of, kind):
    docs = docs_of([(1, "A first line that is prose, as it should be.\n" + LONG[kind])])
    started = time.time()
    assert secrets.scan_secrets(docs).count() == pii.personal_data(docs).count() == 1
    quality.quality(docs).collect()
    pieces = packing.token_pieces(docs, PATH).collect()
    assert sum(p.length for p in pieces) == 1 + sum(p.length == 2048 for p in pieces[:-1]) * 2048 + pieces[-1].length - 1
    assert time.time() - started < 40  # four jobs, two of them of many stages


def test_long_words_have_the_tokenizers_ids():
    tok = WordTokenizer(PATH)
    texts = [LONG["base64"][:3000], "zé" * 900, "%$" * 700, "12" * 600, "short " + "x" * 401 + " " + "y" * 400]
    flat, ends = tok.ids(pa.array(texts))
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        assert flat[a:b].tolist() == tok.whole.encode(t, add_special_tokens=False).ids


def test_line_rules_in_both_forms(spark):
    parts = ["AB", "A", "A.", ".", "-A-", "b", "##", "#", "a##", "%%", "x%%", " ", "\t", "  ", "É!", "\x0b"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 24))) for _ in range(6000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(
        *[F.col("line").rlike(p).alias(n) for n, p in (("a", quality.SYMBOL_ROW), ("b", quality.SYMBOL_ROW_ONCE), ("c", quality.SHOUTED), ("d", quality.SHOUTED_ONCE))], "line")
    got = df.collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    assert 20 < sum(r.a for r in got) < 5950 and 20 < sum(r.c for r in got) < 5950


def test_taken_ranges():
    for _ in range(300):
        spans = [(a, 0, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        a = rng.randint(0, 60)
        b = a + rng.randint(1, 9)
        assert Taken(spans).touches(a, b) == any(s < b and a < e for s, _, e in spans)


def test_contexts_of_any_length():
    text = "x" * 300 + " " + "y" * 300 + " z12345, w99999"
    assert pii.Contexts(text).before(text.index("z1")) == "x" * 300 + " " + "y" * 300
    assert pii.Contexts("one two").before(4) == "" and pii.Contexts("a b c,d").before(6) == "a b"
    assert list(pii.Contexts("a b (ab12345), x").at([5, 7, 15])) == [(0, "a b", "ab12345"), (2, "b (ab12345),", "x")]
