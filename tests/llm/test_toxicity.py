import itertools
import math
import random

import numpy as np
import pytest

from weftgraph.llm import queries, toxicity

WORDS = [f"{a}{b}" for a in ("tree", "house", "river", "stone", "light", "paper", "music") for b in ("", "s", "ing", "ed", "man")]
BAD = ("zorgish", "blickard", "vrumpt")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD).title() + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(words), int(toxic)))
    rows.append((600, " ".join(rng.choice(WORDS) for _ in range(30_000)) + " vrumpt", 1))  # a very long one takes part
    return rows


@pytest.fixture(scope="module")
def field(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in corpus if i % 2 == 0] + [(2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return toxicity.train(docs, labels)


def test_a_fitted_field_finds_documents_and_spans(spark, corpus, field):
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in corpus] + [(None, None, ""), (7000, "", "")], "doc_id long, text string, Score string")
    found = toxicity.score(docs, field).collect()
    assert len(found) == len(corpus) + 2
    labels = {i: y for i, _, y in corpus}
    for r in found:
        if r.doc_id is None or r.doc_id == 7000:
            assert r.score < toxicity.THRESHOLD and r.toxic_spans == []
        elif r.doc_id % 2 and r.doc_id < 600:  # held out
            assert (r.score >= toxicity.THRESHOLD) == bool(labels[r.doc_id])
        if r.text and r.doc_id != 600:
            bad = [m for m in toxicity._TOKEN.finditer(r.text) if toxicity.bare(m[0]) in BAD]
            inside = {k for s in r.toxic_spans for k in range(s["start"], s["end"])}
            assert {m.start() for m in bad} <= inside or r.doc_id % 3
            assert all(any(s["start"] <= m.start() < s["end"] for m in bad) for s in r.toxic_spans)


def test_marginals_and_score_against_all_taggings(field):
    text = "The river Zorgish! music light blickard"
    tokens, unary = text.split(), field.unary()
    total, ones = 0.0, np.zeros(len(tokens))
    for tags in itertools.product((0, 1), repeat=len(tokens)):
        w = math.exp(sum(unary(t) * y for t, y in zip(tokens, tags)) + sum(field.trans[a, b] for a, b in itertools.pairwise(tags)))
        total, ones = total + w, ones + w * np.array(tags)
    (p, _), (q, _) = toxicity._scored(field, [text, "stone " * 700 + text], {})
    assert np.allclose(p, ones / total) and len(q) == 706
    assert toxicity.spans(text, p) == [(10, 18), (31, 39)]


def test_no_documents_and_no_labels(spark, field):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(empty, labels) is None
    assert toxicity.score(empty, field).count() == 0


def test_a_row_without_an_id_is_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.held_out for r in queries.op1_toxicity(spark, str(tmp_path)).where("doc_id is null").collect()} == {False}


def test_the_document_score_settles_where_classes_are_all_but_apart(monkeypatch):
    n, rng = 2000, np.random.default_rng(5)
    y = np.repeat([1, 0], n)
    expected = np.exp(np.where(y == 1, rng.normal(2.2, 0.5, 2 * n), rng.normal(-1.2, 1.1, 2 * n)))
    some = np.where(y == 1, 7, np.clip(np.log(np.expm1(expected)), -7, 7))
    traits = np.column_stack([np.log(expected + 1e-3), some, np.sqrt(expected / rng.choice([60, 300, 900], 2 * n))])
    planted = iter(traits)
    monkeypatch.setattr(toxicity, "document_traits", lambda p: next(planted))
    scale = toxicity.fit([f"word{i}" for i in range(2 * n)], y.tolist(), 0.1, steps=1).scale
    z = (traits * scale[1:]).sum(axis=1) + scale[0]
    over = 1 / (1 + np.exp(-z)) >= toxicity.THRESHOLD
    assert over[y == 1].mean() > 0.99 and over[y == 0].mean() < 0.01


def test_the_driver_holds_the_sample_and_not_the_fit(spark):
    import tracemalloc

    rng = random.Random(9)
    texts = [" ".join(rng.choice(BAD if k == 5 and i % 2 else WORDS) for k in range(60)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    tracemalloc.start()
    try:
        field = toxicity.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3_000_000  # of texts there are 100,000 characters; the gradients alone take more
    rows = sorted((i, t, i % 2) for i, t in enumerate(texts))
    same = toxicity.fit([r[1] for r in rows], [r[2] for r in rows], 0.5)
    assert np.array_equal(field.weights, same.weights) and np.array_equal(field.trans, same.trans) and np.array_equal(field.scale, same.scale)
