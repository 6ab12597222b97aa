"""Bootstrapped personal data: planted identifiers without a base pattern, and scores against a plain loop."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from packetloom.llm import pii


def corpus(n=1000):
    """Texts with e-mail seeds after two contexts, handles after one of these and another, and plain texts; and the handles."""
    rng = random.Random(17)
    vocabulary = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    filler = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    handle = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    handles = [handle() for _ in range(40)]
    rows, planted = [], set()
    for k in range(n):
        text = filler(20)
        if k % 5 in (0, 4):
            text += f" please write to {handle()}@mail.example.org, thanks " + filler(5)
        elif k % 20 in (1, 6):
            h = handles[k // 20 % 40]
            start = len(text) + len(" please write to ")
            text += f" please write to {h}. " + filler(5)
            planted.add((k, start, start + len(h)))
        elif k % 20 == 2:
            h = handles[k // 20 % 40]
            start = len(text) + len(" é member named ")
            text += f" é member named {h}, " + filler(5)
            planted.add((k, start, start + len(h)))
        elif k % 100 == 3:  # no base pattern and not said after the first context
            h = handle()
            start = len(text) + len(" a member named ")
            text += f" a member named {h} " + filler(5)
            planted.add((k, start, start + len(h)))
        rows.append((k, text))
    return rows, planted


def test_planted_identifiers(spark, docs_of):
    rows, planted = corpus()
    got = {(r.doc_id, int(a), int(b)) for r in pii.personal_data(docs_of(rows), confidence=0.4, grow=0.4).collect()
           for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "context"}
    first = {p for p in planted if p[0] % 5 == 1}
    assert first <= got  # after the context of the seeds
    assert len(got & planted) >= 0.95 * len(planted) and len(got & planted) >= 0.95 * len(got)
    # with one round only the context of the seeds is known
    once = {r.doc_id for r in pii.personal_data(docs_of(rows), confidence=0.4, grow=0.4, rounds=1).filter("n_context > 0").collect()}
    assert once == {k for k, _, _ in first}


def test_scores_against_a_loop(spark, docs_of):
    rows, _ = corpus(400)
    rows += [(1000 + k, t) for k, t in enumerate(["", None, "one", "one two", "a b (), c", "see the 1.2.3.4 and the 1.2.3.4"])]
    docs = docs_of(rows)
    seeds = pii.extract(docs, "doc_id", "text").select(F.inline("occurrences")).groupBy("pattern", "value", "whole").agg(F.count("*").alias("n"))
    patterns, believed = pii.learned(docs, "text", seeds, rounds=1, grow=0.3)
    following, seed, wholes = [], set(), defaultdict(set)
    good, total = Counter(), Counter()
    for _, text in rows:
        text = text or ""
        words = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        spans = {max(a for a, _ in words if a <= s): text[s:e] for s, _, e in pii.base_spans(text)}
        for (_, x), (_, y), (a, w) in zip(words, words[1:], words[2:]):
            value = w.strip(pii.EDGE).lower()
            if value:
                pattern = (x.lower(), y.lower())
                following.append((pattern, value))
                total[pattern] += 1
                if a in spans:
                    good[pattern] += 1
                    wholes[pattern].add(spans[a].lower())
                    seed.add(value)
    score = {p: good[p] / total[p] for p in good if len(wholes[p]) >= 3 and good[p] / total[p] >= 0.3}
    weight, often = Counter(), Counter(v for _, v in following)
    for p, v in following:
        if v not in seed and p in score:
            weight[v] += score[p]
    belief = [w / often[v] for v, w in weight.items() if w / often[v] >= 0.3]
    assert sorted(round(r.score, 9) for r in patterns.collect()) == sorted(round(x, 9) for x in score.values()) != []
    assert sorted(round(r.belief, 9) for r in believed.collect()) == sorted(round(x, 9) for x in belief) != []
