import math
import random
from collections import Counter

import numpy as np

from weftgraph.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def test_small_languages_are_judged_by_all_documents(spark):
    rng = random.Random(1)
    common = "the of and to in is it was for on with as at by from that this have not are".split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.6 else f"w{rng.choice('abcdefgh')}rd{rng.choice('aeiou')}n" for _ in range(300))
    junk = lambda: " ".join("".join(rng.choice("0123456789#$%|XYZ") for _ in range(9)) for _ in range(300))
    rows = [(i, prose(), "en") for i in range(2100)] + [(5000, junk(), "q1"), (5001, prose(), "q2"), (5002, junk(), None), (5003, "a b", "q3"), (5004, None, "q1")]
    found = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows) and all(found[i].kept for i in range(2100))
    assert not found[5000].kept and not found[5002].kept and found[5000].js_words > 0.5
    assert found[5001].kept and found[5001].js_words is not None
    assert not found[5003].kept and found[5003].js_words is None
    # A language of enough words is judged by itself, however small its share.
    more = rows + [(6000 + i, prose().upper(), "xx") for i in range(40)]
    judged = {r.doc_id: r for r in quality.rules(spark.createDataFrame(more, SCHEMA)).collect()}
    assert all(judged[6000 + i].kept for i in range(40))


def plain_distance(p, q):
    """Jensen-Shannon distance in bits, by its definition."""
    a, b = sum(p), sum(q)
    total = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return max(total, 0) ** 0.5


def test_verdict_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("sol", "mar", "ter", "lun", "vent") for b in ("a", "e", "ta", "rik", "Õn")]
    prose = lambda n: " ".join(rng.choice(vocabulary) if rng.random() < 0.7 else f"x{rng.randrange(9999)}" for _ in range(n))
    rows = [(i, prose(rng.randrange(40, 200)), "la") for i in range(120)] + [(200, "@#$% " * 90, "la"), (201, " ".join(f"q{k}" for k in range(400)), "la"), (202, prose(51).upper(), "la")]
    found = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    counts = Counter(w for _, t, _ in rows for w in t.encode().split())
    common = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]]
    all_words = [counts[w] for w in common] + [sum(counts.values()) - sum(counts[w] for w in common)]
    kind = lambda text: [sum(c for c in quality.characters(text)[i : i + 1]) for i in range(len(quality.CLASSES))]
    all_kinds = [sum(x) for x in zip(*(kind(t) for _, t, _ in rows))]
    chance = quality.expected(np.array(all_words))
    kept = set()
    for i, text, _ in rows:
        own = Counter(text.encode().split())
        n = sum(own.values())
        if n < quality.MIN_WORDS:
            assert found[i].js_words is None and not found[i].kept
            continue
        by_word = plain_distance([own[w] for w in common] + [n - sum(own[w] for w in common)], all_words)
        by_class = plain_distance(kind(text), all_kinds)
        assert abs(found[i].js_words - by_word) < 1e-9 and abs(found[i].js_characters - by_class) < 1e-9
        limits = quality.MAX_CHARACTERS[0] + quality.MAX_CHARACTERS[1] / n**0.5, np.interp(np.log(n), np.log(quality.LENGTHS), chance) + quality.EXCESS
        good = not found[i].base_failed and by_class <= limits[0] and by_word <= limits[1]
        assert found[i].kept == good, i
        kept |= {i} if good else set()
    assert not kept & {200, 201} and len(kept) > 80


def test_character_classes_by_name():
    text = "aB3 \n.!'#\x01éж"
    want = {"vowel": 1, "consonant": 0, "upper": 1, "digit": 1, "blank": 1, "line": 1, "stop": 2, "quote": 1, "sign": 1, "control": 1, "latin": 1, "letter": 1}
    assert dict(zip(quality.CLASSES, quality.characters(text).tolist())) == want


def test_empty_table(spark):
    assert quality.rules(spark.createDataFrame([], SCHEMA)).count() == 0
