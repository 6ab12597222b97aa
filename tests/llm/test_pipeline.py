"""Toxicity on held-out rows; the pipeline's stages each on their own input."""

import random

import corpus_pipeline
from packetloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.95 and sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(neg)


def test_toxicity_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (None, "text"), (3, "a b"), (3, "a b")]
    got = toxicity.toxicity(docs_of(rows), labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.toxicity(docs_of([]), labels.limit(0)).count() == 0
    # labels of the held-out quarter are not looked at
    rng = random.Random(1)
    many = [(k, " ".join(rng.choice("abcdefghij") * 4 for _ in range(20)) + (" vilify" if k % 3 == 0 else "")) for k in range(400)]
    right = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k, _ in many], "doc_id long, quality int, toxic int")
    flipped = right.withColumn("toxic", toxicity.F.when(toxicity.held_out(right.doc_id), 1 - right.toxic).otherwise(right.toxic))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs_of(many), x).collect()} for x in (right, flipped))
    assert one == two and min(one[k] for k in range(0, 400, 3)) > 0.3 > max(one[k] for k in range(1, 400, 3))


def test_near_copies_by_five_words(spark, docs_of):
    words = [f"word{k}" for k in range(100)]
    near = [w if k not in (30, 60) else "edit" + w for k, w in enumerate(words)]
    sets = [[{tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (words, near)] for n in (4, 5)]
    four, five = (len(a & b) / len(a | b) for a, b in sets)
    assert four < 0.85 and 0.80 <= five < 0.85
    docs = docs_of([(1, " ".join(words)), (2, " ".join(near)), (3, "something else altogether that nobody has copied from")])
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()) == [1, 3]


def test_stages(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "secrets":
            assert docs.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and 1.4 < counts[4] / counts[3] < 1.6 and counts[5] >= counts[4]
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_stages_on_odd_tables(spark, docs_of):
    odd = docs_of([(1, None), (2, ""), (None, "no id"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x " * 50_000)])
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, "/root/testdata/sf0.001").count()
