"""Mixing, quality, packing, joins and chat against brute force on small tables, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import chat, components, egrid, jaccard, mixing, packing, quality
from packetloom.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_ids_equal_the_tokenizer():
    tok, rng = WordTokenizer(PATH), random.Random(3)
    letters = "abAZéÉß'’½²³ 09\n\t_-+<|>é́ΣİK\x85\xa0\x1c,.s'td'llªº×ſĿŉ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", "", "<|endoftext|>"]) for _ in range(3000)]
    texts += ["".join(rng.choice("aabbeoothn'") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    flat, ends = tok.ids(pa.array(texts))
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        assert flat[a:b].tolist() == tok.whole.encode(t, add_special_tokens=False).ids


def test_mixing(spark, docs_of):
    rng = random.Random(1)
    rows = [(k, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), rng.choice(["b", "a", None, "c", "z"])) for k in range(400)]
    rows += [(7, "same words here", "b")] * 2 + [(None, "no id", "a"), (900, None, "a"), (901, "", None), (902, "one", "tiny")]
    got = mixing.taken_words(docs_of(rows), block_words=16).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, text, source in rows:
        size[(source is None, source or "")] += len(WORD.findall(text or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    # deal and deal again until nothing is above
    left, target = 1.5 * sum(size.values()), {}
    open_ = set(size)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    by_size = {size[s]: target[s] for s in size}
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 2 * r.size
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    for s in size:
        assert abs(taken[size[s]] - target[s]) <= 1
    again = mixing.taken_words(docs_of(rows), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.taken_words(docs_of([])).count() == 0
    mix, _ = mixing.mix_sources(docs_of(rows), block_words=16)
    slots = mix.groupBy("slot").agg({"skey": "max", "part_words": "sum"}).collect()
    assert all(r["sum(part_words)"] <= 16 for r in slots)
    assert {r.doc_id for r in mixing.mixed_documents(docs_of(rows)).collect()} >= {901, 900}


words = st.lists(st.sampled_from(["a", "b", "c.", "d|", "##", "HOME", "E", "\n", "x y z w v."]), max_size=60).map(" ".join)


def test_quality_counts_repeats_of_short_texts(spark, docs_of):
    texts = ["ha " * k for k in range(4, 11)] + ["a b " * 4, "a b c " * 3, "a b c d " * 2, "one two three four five six"]
    got = {r.doc_id: r for r in quality.quality(docs_of(list(enumerate(texts))), min_words=5).collect()}
    for k, text in enumerate(texts):
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        assert got[k].n_repeat_words == len(cover)
        assert got[k].base_failed == (len(w) < 5 or 100 * len(cover) > 20 * len(w))


def test_quality(spark, docs_of):
    rng = random.Random(2)
    pool = ["a", "b", "c.", "d|", "## ", "HOME", "\n", "x y z w v.", "é", "\t"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(150)] + [None, "", "word", "one two three four five six seven eight nine ten."]
    texts += texts[:3]
    for r in quality.quality(docs_of(list(enumerate(texts)))).collect():
        text = texts[r.doc_id] or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed) and r.spans == "x"
    assert quality.quality(docs_of([])).count() == 0
    menu = "Home | News | Sport | Weather | More\n" * 3 + "Short line"
    assert not quality.quality(docs_of([(1, menu + " and a b c d e f g")])).first().kept


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_every_piece_once(counts):
    plan = packing.plan(counts, 64)
    placed = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 64
        for x in pattern:
            placed[x] += times
    assert placed == Counter(counts)
    bins, least = sum(t for _, t in plan), -(-sum(k * v for k, v in counts.items()) // 64)
    assert bins <= least + max(2, least)


def test_packing(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "hello world " * 1500), (3, "hello world " * 1500), (None, "x"), *[(k, "word " * (k * 7 % 400)) for k in range(10, 200)]]
    got = packing.pack_documents(docs_of(rows), PATH).collect()
    tok, want = WordTokenizer(PATH), []
    for i, text in rows:
        ids = np.array(tok.whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i or -1, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1
    assert packing.pack_documents(docs_of([]), PATH).count() == 0


def edited(rng, base, rate):
    return " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) if rng.random() < rate else w for w in base)


def reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard(spark, docs_of):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "One  TWO"), (6, "one two three")]
    for _ in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 160))]
        base += passage if rng.random() < 0.4 else []
        for _ in range(rng.randint(1, 14)):
            rows.append((len(rows) + 10, edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))))
    rows += [(rows[20][0], rows[20][1]), (None, rows[21][1])]
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        s = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
        if i is not None:
            sets[i] = s
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[b]]
    want = reachable(ids, links)
    got = jaccard.similar_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    stay = [r.doc_id for r in jaccard.one_of_each(docs_of(rows)).collect()]
    assert sorted(i for i in stay if i is not None) == sorted({want[i] for i in ids}) and stay.count(None) == 1
    assert jaccard.similar_documents(docs_of([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and len({got[k] for k in range(100, 140)}) == 1 and got[0] != got[100]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=8).tolist() for _ in range(60)]
    for _ in range(300):
        vectors.append((np.array(vectors[rng.integers(0, 60)]) + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])).tolist())
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0],
           [1e200] * 8, [1e200] * 8, [3e-200] + [0.0] * 7, [7e-300] + [0.0] * 7, [5e-324] * 8, [1.0] * 8, [1e308, -1e308] * 4]
    rows = list(enumerate(vectors + odd)) + [(3, vectors[3])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int, kept int")
    good = [(k, np.array(v) / np.abs(v).max()) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    near = [(a, b) for n, (a, x) in enumerate(good) for b, y in good[n + 1 :] if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95]
    count = Counter(k for pair in near for k in pair)
    root = reachable(range(len(rows)), near)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((i, count[k], least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(rows))
    assert sorted(tuple(r) for r in egrid.near_vectors(df).collect()) == want
    assert egrid.near_vectors(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<s>"]), st.text(alphabet="<[\\/s>|\n ab]INTé", max_size=12)), max_size=6))
def test_template_round_trip(messages):
    form = chat.TurnTemplate()
    assert form.parse(form(messages)) == messages
    text, spans = chat.locate(form, [], messages, {})
    assert form.begin + text == form(messages)
    for (_, said), (a, b, c, d, stable) in zip(messages, spans):
        assert stable and a <= c <= d <= b and form.unescape(text[c:d]) == said
    for control in (form.turn, form.end, form.begin, "[INST]"):
        assert control not in form.escape("".join(t for _, t in messages) + control)


def test_chat(spark):
    class Forgetful(chat.TurnTemplate):
        """Shortens all but the last turn, as templates that drop reasoning do."""

        def __call__(self, messages):
            return chat.TurnTemplate.__call__(self, [(r, t if k == len(messages) - 1 else t[:3]) for k, (r, t) in enumerate(messages)])

    rows = [(1, 0, "user", "a <s> b", "x"), (1, 1, "assistant", None, "x"), (1, None, "system", "sys", "x"), (None, 3, None, "t", "x"), (2, 5, "assistant", "z", "x"), (2, 5, "assistant", "z", "x")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k} \\ [INST]", "x") for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    form = chat.TurnTemplate()
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in said if role == "assistant")
        want = (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(form(said)), 0)
        assert tuple(got[conv])[1:] == want
    pieces = chat.format_conversations(df.filter("conv_id = 3"), Forgetful()).collect()
    assert any(not s["stable"] for p in pieces for s in p.spans) and all(not (s["loss"] and not s["stable"]) for p in pieces for s in p.spans)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_templates_see_true_prefixes(spark):
    class Forgetful(chat.TurnTemplate):
        def __call__(self, messages):
            return chat.TurnTemplate.__call__(self, [(r, t if k == len(messages) - 1 else t[:3]) for k, (r, t) in enumerate(messages)])

    def numbered(messages):
        return "".join(f"({t})" for _, t in messages[:1]) + "".join(f"{k}.{messages[0][1]}.{r}:{t};" for k, (r, t) in enumerate(messages))

    said = [(("user", "assistant")[k % 2], f"turn {k} of many") for k in range(130)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    (piece,) = chat.format_conversations(df, Forgetful()).collect()
    assert piece.formatted == Forgetful()(said) and not any(s["stable"] or s["loss"] for s in piece.spans)
    (piece,) = chat.format_conversations(df, numbered).collect()
    assert piece.formatted == numbered(said) and len(piece.spans) == 130
    for (_, text), s in list(zip(said, piece.spans))[1:]:
        assert s["stable"] and piece.formatted[s["text_start"] : s["text_end"]] == text
