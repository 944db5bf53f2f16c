import math
import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import pyarrow as pa

from weftgraph.llm import suffixtree

SCHEMA = "doc_id long, text string, word string"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [" "]


def test_base_columns_against_brute_force(spark):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 40)), "x") for i in range(200)] + [(7, "W1 w2", None), (None, None, None), (500, "", "y"), (501, "\t  \x0b", "y"), (502, "ÄB " * 9000, "y")]
    found = suffixtree.language_model(spark.createDataFrame(rows, SCHEMA)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(t for i, x, _ in rows if not held(i) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, x, _ in rows:
        ts = tokens(x)
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts)
        want[i, held(i), len(ts), sum(train[t] > 0 for t in ts), n, round(base, 3)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_contexts_help_on_held_out_text_and_sum_to_one(spark):
    rows = [(i, " ".join("abc"[(i + k) % 3] for k in range(40)), None) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = suffixtree.language_model(docs).where("held_out").collect()
    assert found and all(r.score > r.base_score / 3 for r in found)
    import numpy as np

    model = suffixtree.learn(docs)
    tree, roots = model.tree, model.roots
    assert len(tree.rest)
    for state in range(len(tree.rest)):
        p = tree.probability(np.full(len(roots), state), np.arange(len(roots)), roots)
        unknown = tree.probability(np.array([state]), np.array([-1]), np.array([1 - roots.sum()]))
        assert abs(p.sum() + unknown[0] - 1) < 1e-9


def brute_scores(rows, held):
    """The suffix tree in dictionaries, contexts of up to three tokens."""
    count, follow = Counter(), {}
    for i, x, _ in rows:
        if held(i):
            continue
        ts = tokens(x)
        count.update(ts)
        for at, t in enumerate(ts):
            past = ("START", *ts[:at])
            for d in range(1, min(3, len(past)) + 1):
                follow.setdefault(past[-d:], Counter())[t] += 1
    n, v = sum(count.values()), len(count)
    floor, least = suffixtree.floors(n)
    root = lambda t: (count[t] + 1) / (n + v + 1)
    kept = {}

    def suffix(c):
        while c and c not in kept:
            c = c[1:]
        return c

    def p(c, t):
        return kept[c][1].get(t, 0.0) + kept[c][0] * p(suffix(c[1:]), t) if c else root(t)

    for c in sorted(follow, key=lambda c: (len(c), c)):
        times, total = follow[c], sum(follow[c].values())
        symbols = sorted(t for t, k in times.items() if k >= least and count[t] >= least)
        # A start is a candidate however seldom it occurs, a longer context if it occurs often enough.
        if not symbols or any(count[w] < least for w in c if w != "START") or c != ("START",) and context_count(follow, count, c) < floor:
            continue
        share = {t: (times[t] - 0.7) / total for t in symbols}
        rest, up = 1 - sum(share.values()), {t: p(suffix(c[1:]), t) for t in symbols}
        q = {t: share[t] + rest * up[t] for t in symbols}
        other, above = max(1 - sum(q.values()), 1e-12), max(1 - sum(up.values()), 1e-12)
        kl = sum(q[t] * math.log(q[t] / up[t]) for t in symbols) + other * math.log(other / above)
        if kl >= 0.01 and kl * total >= 10:
            kept[c] = rest, share
    for _, x, _ in rows:
        past, total = ("START",), 0.0
        for t in tokens(x):
            total += math.log10(p(suffix(past[-3:]), t))
            past += (t,)
        yield total
    assert any(len(c) == 3 for c in kept)


def context_count(follow, count, c):
    return count[c[0]] if len(c) == 1 else follow.get(c[:-1], {}).get(c[-1], 0)


def test_scores_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(150):
        x = [rng.choice("abcdefg") for _ in range(3)]
        while rng.random() < 0.97:
            x.append({"a": "b", "b": x[-2]}.get(x[-1], rng.choice("abcdefg")) if rng.random() < 0.8 else rng.choice(["rare%d" % rng.randrange(300), *"abc"]))
        rows.append((i, " ".join(x), None))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = {r.doc_id: r.score for r in suffixtree.language_model(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (i, _, _), want in zip(rows, brute_scores(rows, held)):
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), i


def test_empty_table(spark):
    assert suffixtree.language_model(spark.createDataFrame([], SCHEMA)).count() == 0


PEAK = """
import random, sys
import pyarrow as pa, pyspark
from weftgraph.llm import suffixtree
pyspark.TaskContext = type("Context", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)})
rng, words = random.Random(1), [f"word{i}" for i in range(20_000)]
def batches():
    for at in range(0, 8192, 512):
        texts = [" ".join(rng.choices(words, k=200)) for _ in range(512)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(at, at + 512)), "held_out": [False] * 512, "text": texts})
for _ in suffixtree._blocks(1 << 40)(batches()):
    pass
print(pa.default_memory_pool().max_memory() / (8192 * 200 * 10))
"""


def test_a_block_takes_little_more_than_its_texts():
    root = Path(suffixtree.__file__).parents[2]
    peak = subprocess.run([sys.executable, "-c", PEAK], env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    assert float(peak.stdout) < 3


def test_words_are_numbered_alike_however_texts_are_dealt():
    texts = ["A b\tC", None, "", "c d a", " \x0b", "B e"]
    words, codes, ends = suffixtree.tokenize(pa.array(texts))
    for cut in range(7):
        w, c, e = suffixtree.tokenize(pa.chunked_array([pa.array(texts[:cut], pa.string()), pa.array(texts[cut:], pa.string())]))
        assert (w, c.tolist(), e.tolist()) == (words, codes.tolist(), ends.tolist())
    assert words.to_pylist() == ["a", "b", "c", "d", "e", " "] and suffixtree.tokenize(pa.chunked_array([], pa.string()))[1].tolist() == []
