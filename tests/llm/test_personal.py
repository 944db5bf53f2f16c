import hashlib
import re

from pyspark.sql import functions as F

from weftgraph.llm import personal

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None,
    "",
    "mail a.b%c@x-1.example.com, c@d.e_f@g.h;x@y a@b.c.d.",
    "äöü😀 1.2.3.4 1.2.3.4.5 256.1.1.1 001.002.000003.255 9999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 79927398713 " + "4" * 15000,
    "+1 (017) 555-7713 and +49 30 123456 +1-2 ++123456789+987654321 +1" + "(" * 9000,
    "a.b@" * 3000 + "x.y" + "@" * 50 + "q" * 3000,
    "1 " * 8000 + "a@b." * 2000,
    "reach joe at mail dot example dot org or (555) 123-4567; fe80:1:2:3:4:5:6:7",
] + [f"call +1 ({i}17) 555-77{i}3 card {4111111111111111 + i} ip 10.{i}.2.{i * 40}" for i in range(10)]


def number(name, m):
    """The check of a proposal, said plainly."""
    digits = re.sub("[^0-9]", "", m)
    if name == "email":
        return bool(re.search(r"(\.|dot|DOT|\))\s*[A-Za-z]{2,24}$", m) and re.search(r"(@|at|AT).*(\.|dot|DOT)", m))
    if name == "ip":
        if "." in m:
            return all(int(x) <= 255 for x in m.split("."))
        groups = m.split(":")
        gaps = m.count("::")
        lengths = [len(x) for x in groups if x]
        return not (gaps == 0 and all(x == 2 for x in lengths[1:]) and lengths[0] <= 2) and (gaps == 1 and len(lengths) <= 7 or gaps == 0 and len(groups) == 8)
    if name == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    a = re.split("[./-]", m)
    date = len(a) == 3 and m.replace(".", "").replace("/", "").replace("-", "").isdigit() and (len(a[0]) < 3 and len(a[1]) < 3 and 2 <= len(a[2]) <= 4 or len(a[0]) == 4 and len(a[1]) < 3 and len(a[2]) < 3)
    return 9 <= len(digits) <= 15 and not date


def traits(k, m, before, after):
    name, digits = personal.KINDS[k], re.sub("[^0-9]", "", m)
    n, numeric = len(digits), personal.KINDS[k] in ("card", "phone")
    local = len(re.match("[A-Za-z0-9._%+-]*", m)[0])
    side = lambda x: 0 if not x else 1 if x in " \t\n\x0b\f\r" else 2 if x in ".,;:!?'\")](["  else 3 if x in "0123456789" else 4
    return {
        "kind": k,
        "groups": min(len(re.split("[^0-9A-Za-z]+", m)), 6) if numeric else 0,
        "separator": next((i for i, c in zip((1, 2, 3, 4), " -./") if c in m), 0) if numeric else 0,
        "digits": (0 if n < 12 else 1 if n < 16 else 2 if n == 16 else 3 if n <= 19 else 4) if name == "card" else 0,
        "letters": int(bool(re.search("[A-Za-z]", m))) if name == "ip" else 0,
        "local": (0 if local < 3 else 1 if local < 6 else 2 if local < 12 else 3) if name == "email" else 0,
        "cue": int(bool(re.search(personal.CUES[name], before.lower()))),
        "before": side(before[-1:]),
        "after": side(after),
        "paren": int(name == "phone" and "(" in m),
    }


def proposals(text):
    """(kind, start, end, check, features) of everything that a generator finds outside the base spans of its kind."""
    for k, name in enumerate(personal.KINDS):
        masked = text
        for a, _, b in (x for x in brute(text) if x[1] == k):
            masked = masked[:a] + "\x04" * (b - a) + masked[b:]
        last = 0
        for m in re.finditer(personal.GENERATORS[name], masked):
            yield k, m.start(), m.end(), number(name, m[0]), traits(k, m[0], masked[last : m.start()][-24:], masked[m.end() : m.end() + 1])
            last = m.end()


MORE = [
    "write joe at mail dot example dot org now", "joe (at) mail (dot) org", "he looked at the sea", "a@b", "fe80::1 and 2001:db8::8:800:200c:417a", "at 12:30:45 or 00:1a:2b:3c:4d:5e",
    "fe80:1:2:3:4:5:6:7 x 1::2::3", "on 12.05.2021 or 2021-05-12 call 0301 234 5678 or (555) 123-4567", "4111 1111-1111 1111 or 4111.1111.1111.1111 or 4111.1111.1111.1112", "tel 555 123 4567, v1.2.3.4.5",
]


def test_proposals_checks_and_features_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + MORE)], "doc_id long, text string")
    for r in personal.candidates(docs).collect():
        text = r.text or ""
        got = [(c.kind, c.start, c.end, c.check, c.f.asDict()) for c in r._more if not c.base and (c.start, c.kind, c.end) not in failed(text)]
        assert got == [x for x in proposals(text) if (x[1], x[0], x[2]) not in failed(text)], text[:80]
        assert all(text[c.start : c.end] for c in r._more)


def failed(text):
    """Matches of base patterns that don't pass."""
    return {(m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text)} - set(brute(text))


def test_chosen_spans_pass_check_and_threshold(spark):
    rows = []
    for i in range(1200):
        card = f"4{i:014d}"
        card += str(next(d for d in range(10) if luhn(card + str(d))))
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        grouped = lambda c, s: s.join(c[j : j + 4] for j in range(0, 16, 4))
        rows.append(f"card number {grouped(card, ' ')}. item {wrong} sold")
    rows += [f"card number {grouped(c, '.')}. ok" for c in ("4111111111111111", "4111111111111112")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = personal.materialize(personal.candidates(docs), "test-personal")
    trees = personal.train(found)
    assert 2 in trees.thresholds and 0 not in trees.thresholds
    got = {(r.doc_id, *s) for r in personal.choose(found, trees).collect() for s in r.found}
    want = {(i, *s) for i, t in enumerate(rows) for s in brute(t)}
    want |= {(i, a, k, b) for i, t in enumerate(rows) for k, a, b, ok, f in proposals(t) if ok and trees.margin(f) >= trees.thresholds.get(k, float("inf"))}
    assert got == want
    precision = personal.measured(trees, personal.labelled(found)[1])["card"][2]
    assert precision >= personal.PRECISION


def test_a_text_with_very_many_matches(spark):
    text = "".join(f"u{i}@h.org 10.0.{i % 300}.1 " for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in personal.redacted(personal.spans(docs)).collect()}
    assert [tuple(s) for s in rows[1].base] == brute(text) and rows[2].base == [] and rows[2].text is None
    assert rows[1].text == "".join("[EMAIL] " + ("[IP] " if i % 300 < 256 else f"10.0.{i % 300}.1 ") for i in range(20_000))


def test_base_spans_and_features(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, base string")
    found = personal.redacted(personal.spans(docs).withColumn("clean", F.col("text")), "clean").withColumn("l", personal.listed(F.col("base"))).collect()
    assert len(found) == 2 * len(TEXTS)
    for r in found:
        base = [tuple(s) for s in r.base]
        assert base == brute(TEXTS[r.doc_id]), r.doc_id
        assert set(base) <= {tuple(s) for s in r.found}
        assert r.l == ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        if r.text:
            for a, _, b in base:
                assert r.text[a:b] not in r.clean or len(r.text) > 3000
            covered, clean, at = sorted(tuple(s) for s in r.found), "", 0
            for a, k, b in covered:
                if a >= at:
                    clean += r.text[at:a] + f"[{personal.KINDS[k].upper()}]"
                at = max(at, b)
            assert r.clean == clean + r.text[at:]
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def test_trees_learn_and_agree_with_their_expression(spark):
    rows = [({f: 0 for f in personal.FEATURES} | {"kind": 2, "digits": d, "cue": s}, int(s and d == 4), 100.0) for d in range(6) for s in (0, 1)]
    trees = personal.fit(rows)
    table = spark.createDataFrame([(tuple(x[f] for f in personal.FEATURES),) for x, _, _ in rows], "f struct<" + ",".join(f"{f}:int" for f in personal.FEATURES) + ">")
    margins = [r[0] for r in table.select(trees.column(F.col("f"))).collect()]
    assert all(abs(m - trees.margin(x)) < 1e-9 for m, (x, _, _) in zip(margins, rows))
    assert {(m >= trees.thresholds[2]) for m, (_, y, _) in zip(margins, rows) if y} == {True}
    assert not any(m >= trees.thresholds[2] for m, (_, y, _) in zip(margins, rows) if not y)
    assert personal.fit([]).thresholds == {}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert personal.spans(docs).count() == 0
