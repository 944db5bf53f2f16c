import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import packing, pieces, quality, queries, quotes, simhash, toxicity, warc
from weftgraph.llm.kdtree import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, kept int"
ODD = [(1, None, None, None, None, None, None, None), (2, "", "", "", 0, "x", "y", 1), (None, "a b c", "en", "s", 5, "", "", 0), (3, "A  b\tC", "en", "s", 5, "", "", 0), (3, "A  b\tC", "en", "s", 5, "", "", 0), (4, "word " * 30_000, "en", "s", 5, "", "", 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def model():
    with open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return f.read()


# ---- quotation linking -------------------------------------------------------


def test_quotes_link_nested_levels(spark):
    rows = [
        (1, 0, "a", "Is it raining?\nI can't see."),
        (1, 1, "b", "hello there"),
        (1, 2, "b", "A wrote:\n> Is it   RAINING?\n> I can't see.\nYes."),
        (1, 3, "a", "> > Is it raining?\n> Yes.\nThanks."),
        (2, 0, "c", "> hello there\nforwarded"),
        (2, 1, None, None),
        (None, None, "c", "> nobody said this"),
        (2, 1, None, None),
    ]
    found = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r for r in found.collect()}
    assert found.count() == 8
    assert got[1, 2].parent_turn == 0 and got[1, 2].clean_text == "Yes." and got[1, 2].root_turn == 0
    assert got[1, 3].parent_turn == 2 and got[1, 3].max_depth == 2 and got[1, 3].n_linked == 2 and got[1, 3].root_turn == 0
    assert [got[1, t].position for t in (0, 2, 3, 1)] == [0, 1, 2, 3]
    assert got[2, 0].n_other_conv == 1 and got[2, 0].parent_turn is None
    assert got[None, None].n_passages == 1 and got[None, None].n_linked == 0
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- sentencepiece -----------------------------------------------------------


def test_pieces_round_trip_and_parity(spark, model, odd):
    import sentencepiece

    texts = ["Hello  world", " lead and trail ", "naïve 😀 漢字\tx\n\ny", "a" * 5000, "<s> </s> <0x41>", None, "", "Größe " * 2000]
    found = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in found:
        assert list(r.ids) == theirs.encode(r.text or "") and r.parity and r.round_trip, r.text
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
    back = pieces.decode(pieces.encode(odd, model), model).select("doc_id", "text").collect()
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in back))) == sorted(map(str, ((r[0], r[1] or "") for r in ODD)))


def test_unigram_model_is_rebuilt():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("▁a", -1, 1), ("▁", -2, 1), ("a", -2.5, 1), ("b", -3, 1), ("ab", -3.1, 1), *((f"<0x{i:02X}>", 0, 6) for i in range(256))]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    made = pieces.Codec(m.SerializeToString())
    assert made.model.kind == pieces.UNIGRAM
    texts = ["ab a b", "aab  é", "", "bbb aaa", "   ", " a", "b  ", "\ta\n", None, "a" * 3000]
    flat, ends, parity, back = made.encode(pa.array(texts, pa.string()))
    assert parity.all() and back.all()
    for text, a, b in zip(texts, [0, *ends[:-1]], ends):
        assert made.decode(flat[a:b].tolist()) == (text or "")
    m.normalizer_spec.remove_extra_whitespaces = True
    squeezing = pieces.Codec(m.SerializeToString())
    assert squeezing.encode(pa.array(["a  b", "  a ", "\ta ", "a\n", "  ", ""], pa.string()))[2].all()
    # A piece that reaches over a blank: texts can't be cut there.
    m.normalizer_spec.remove_extra_whitespaces = False
    m.pieces.add(piece="a▁b", score=-0.5, type=1)
    crossing = pieces.Codec(m.SerializeToString())
    assert not crossing.splits and crossing.encode(pa.array(["a b a b", "b a"], pa.string()))[2].all()


def test_pieces_of_an_empty_table(spark, model):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_pieces_of_blanks_in_every_place(model):
    import sentencepiece

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "  ", "\n", "é", "▁", "漢", "the"]) for _ in range(rng.randrange(9))) for _ in range(3000)]
    made, theirs = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for _ in range(2):  # the second time from memory
        flat, ends, parity, back = made.encode(pa.array(texts))
        assert parity.all() and back.tolist() == ["▁" not in t for t in texts]
        assert [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == theirs.encode(texts)


# ---- WARC --------------------------------------------------------------------


def test_warc_round_trip_and_damage(spark):
    same = "x" * 1500
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 30, "c") for i in range(40)] + [(100, "u", same, ""), (101, "u", same, ""), (102, None, None, None), (None, "n", same, ""), (7, "z", "y" * 999, ""), (8, "z", "y" * 999, "")]
    path = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), archive_bytes=4000)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(rows)
    assert {(r.page_id, r.kind, r.refers_to) for r in found if r.payload_bytes == 1500} == {(101, "response", None), (100, "revisit", 101), (None, "revisit", 101)}
    data = bytes(spark.read.format("binaryFile").load(path).orderBy(F.desc("length")).first()["content"])
    assert list(warc.records(data))
    for bad in (data[:-1], data[4:], data[:8] + data[9:], data[:-12] + b"\0" * 12):
        with pytest.raises(Exception):
            list(warc.records(bad))
    good = warc.pack_record(warc.Record("response", 1, "u", 2, "b6589fc6ab0dc82cf12099d1c2d40ab994e8410c", None, b"00"))
    for bad in (good, good[:-4], good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadArchive):
            warc.read_record(bad)


# ---- the others, against brute force on odd rows ------------------------------


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    bits = [rng.getrandbits(64) for _ in range(6)]
    family = [bits[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    fps = [*bits, *family, bits[1] ^ 1, bits[1] ^ 7, 0, 1, 6]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes, at = spark.createDataFrame([(f,) for f in signed], "fp long"), {f: i for i, f in enumerate(signed)}
    want = {(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2}

    def parts(links):
        up = list(range(len(fps)))
        for a, b in links:
            ra, rb = up[a], up[b]
            up = [min(ra, rb) if x in (ra, rb) else x for x in up]
        return up

    for crowd in (2, 24, 1000):
        got = {(at[r.src], at[r.dst]) for r in simhash.links(classes, pair_cell=crowd).collect()}
        assert parts(got) == parts(want)


def test_simhash_odd_rows(odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}


def test_simhash_links_through_rows_without_an_id(spark, monkeypatch):
    rows = spark.createDataFrame([(5, 0), (None, 3), (9, 15), (None, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: rows)
    assert sorted(simhash.near_duplicates(None).collect(), key=str) == [(5, 0, 5), (9, 15, 5), (None, -1, None), (None, 3, 5)]


def test_fingerprints_against_brute_force(spark):
    from xxhash import xxh64_intdigest

    rng = random.Random(9)
    texts = [None, "", "One", "one TWO", "Ä ä\tÄ\x0b\x0c\r\nB É"] + [" ".join(rng.choice(["a", "B", "Éa", "漢\u00a0x", "dd"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f")).collect():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        assert r.f == f"{bits:016x}"


def test_quality_odd_rows(odd):
    found = quality.rules(odd).collect()
    assert len(found) == len(ODD) and {r.n_words for r in found} == {0, 3, 30_000}
    assert quality.base_counts("a b c a b c\n\nx x\nx x") == (10, 10, 0, 1, 10)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(found) == len(ODD) and {r.score for r in found} == {0.0}
    u, t = np.array([0.3, -1.0, 2.0]), np.array([[0.1, -0.2], [0.4, 0.3]])
    total, ones = 0.0, np.zeros(3)
    for y in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]:
        w = np.exp(sum(u[i] * y[i] for i in range(3)) + t[y[0], y[1]] + t[y[1], y[2]])
        total, ones = total + w, ones + w * np.array(y)
    assert np.allclose(toxicity.marginals(u, np.array([True, False, False]), t), ones / total)


def test_packing_odd_rows(odd):
    found = packing.pack(odd, queries.tokenizer_file("word_bpe_49k.json")).collect()
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in found if r.start == 0 or True) == sum(n for n in [1, 1, 4, 4, 4, 30_001])
    assert sorted(by) == list(range(len(by)))


def test_packing_ids_against_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    rng = random.Random(6)
    texts = [None, "", "Hello  wörld\n\tx", "漢字 😀 don't 12345"] + [" ".join(rng.choice(["alpha", "Beta9", "γάμμα", "x" * 40, "1,000.5", "\n\n", "it's"]) for _ in range(rng.randrange(1500))) for _ in range(12)]
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    plain = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        pieces_ = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found if r.doc_id == i)
        at = 0
        for start, length, crc, total in pieces_:
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))
            at += length
        assert at == len(ids)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_column_generation_meets_its_gap():
    rng = random.Random(2)
    counts = {rng.randrange(1, 257): rng.randrange(1, 5000) for _ in range(150)}
    found = packing.plan(counts, 256)
    sizes = np.array(sorted(counts))
    columns, used = packing.column_generation(sizes, np.array([float(counts[k]) for k in sizes]), 256)
    assert (sizes @ columns <= 256 + 1e-9).all() and (columns @ used >= [counts[k] - 1e-6 for k in sizes]).all()
    # No pattern is worth more than the gap allows: duals from the basis, priced over all patterns.
    duals = np.linalg.solve(columns.T, np.ones(len(sizes)))
    assert packing.price(duals, sizes, 256)[0] <= 1 / (1 - packing.GAP) + 1e-6
    assert used.sum() * (1 - packing.GAP) <= found.sequences <= used.sum() + len(counts)
    for k, n in counts.items():
        assert sum(high - low for c, low, high, _, _ in found.ranges if c == k) == n


def test_warc_of_an_empty_table_and_a_large_page(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.archive(empty)).count() == 0
    rng = random.Random(1)
    big = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(200_000))  # over one step of 64 KB when compressed
    rows = spark.createDataFrame([(1, "u", big), (2, "u", "small")], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_bytes) for r in warc.read_archives(spark, warc.archive(rows)).collect()} == {(1, len(big.encode())), (2, 5)}


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kdtree_against_brute_force_over_many_shards(spark):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [rng.gauss(m, 0.1) for m in centres[i % 12]]) for i in range(900)] + [(i, [0.5] * 6) for i in range(900, 1500)] + [(1600, [0.25] * 3)]
    whole = {i: [math.floor(1024 * x) for x in v] + [0] * (6 - len(v)) for i, v in rows}
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, shard_rows=50).collect()
    want = {(q, r + 1, i, -s) for q in whole if q % 100 == 0 for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7])}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_kdtree_ties_and_odd_vectors(spark):
    rows = [(i, [float(i % 3), 0.5]) for i in range(250)] + [(300, None), (301, [float("nan"), 1.0]), (302, [None, 1.0]), (None, [9.0, 9.0]), (100, [9.0, 9.0])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, shard_rows=64).collect()
    good = [(i, [int(x * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    for q in (0, 200):
        query = dict(good)[q]
        want = sorted(((-sum(a * b for a, b in zip(query, v)), i) for i, v in good if i != q))[:3]
        assert sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
