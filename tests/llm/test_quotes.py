import random

from weftgraph.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    return {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_another_conversation_is_found_whoever_is_least(spark):
    got = linked(spark, [(1, 0, "a", "> hello\nhello"), (2, 0, "b", "hello"), (3, 0, "a", "> later"), (3, 1, "a", "later"), (4, 0, "b", "later"), (None, 0, "a", "> own\nown"), (9, 0, "a", "own")])
    assert [got[c, 0].n_other_conv for c in (1, 3, None)] == [1, 1, 1]


def test_the_message_with_most_of_the_passage_wins(spark):
    rows = [(1, 1, "a", "Thanks."), (1, 5, "b", "Unique line\nThanks.\nmore"), (1, 6, "a", "> Unique line\n> Thanks.\nok")]
    rows += [(2, 0, "a", "x\ny"), (2, 1, "b", "x"), (2, 2, "a", "y"), (2, 3, "b", "y\nq\nx"), (2, 4, "a", "x"), (2, 5, "b", "> y\n> q\n> x\n> z"), (2, 6, "a", "> nothing\n")]
    rows += [(3, None, "a", "first"), (3, 1, "b", "> first")]
    got = linked(spark, rows)
    assert got[1, 6].parent_turn == 5 and got[2, 5].parent_turn == 3
    assert got[2, 6].parent_turn is None and got[3, 1].n_linked == 1 and got[3, 1].n_other_conv == 0


def test_originals_against_all_messages(spark):
    rng, lines = random.Random(4), "abcdefgh"
    rows = [(1, k, "a", t) for k, t in enumerate(["x", "y", "z", "z\nq\ny\nq\nx", "x", "y", "z", "> x\n> y\n> z\nok"])]
    rows += [(2, k, "a", t) for k, t in enumerate(["u", "v", "w"])] + [(3, 0, "a", "w\nq\nv\nq\nu"), (4, 0, "a", "> u\n> v\n> w")]
    for conv in (*range(10, 22), None):
        for turn in (None, *range(rng.randrange(3, 14))):
            own = [rng.choice(lines) + str(conv) * (rng.random() < 0.6) for _ in range(rng.randrange(5))]
            quoted = [rng.choice(lines) + str(conv) * (rng.random() < 0.6) for _ in range(rng.randrange(6))]
            rows.append((conv, turn, "a", "\n".join(["> " + x for x in quoted] + own)))
    at = lambda turn: quotes.NO_TURN if turn is None else turn
    own = {(c, at(t)): [x.lower() for x in text.split("\n") if x and not x.startswith(">")] for c, t, _, text in rows}
    want = {}
    for c, t, _, text in rows:
        passage = [x[2:].lower() for x in text.split("\n") if x.startswith(">")]
        weigh = {m: sum(x in o for x in passage) + (o == passage) * (len(passage) + 1) for m, o in own.items()}
        # A one-line message's whole text is that line; its hash is the line's own, too.
        if len(passage) == 1:
            weigh = {m: (1 + 2 * (len(passage) == 1)) * (passage[0] in o) for m, o in own.items()}
        best = [(0, m) for m, n in weigh.items() if n and m[0] == c and m[1] < at(t)] or [(1, m) for m, n in weigh.items() if n and m[0] != c]
        if passage and best:
            out, (conv, turn) = min(best, key=lambda b: (-weigh[b[1]], b[1][0] is not None, b[1][0] or 0, b[1][1]))
            want[c, t] = out, conv, None if turn == quotes.NO_TURN else turn
    _, found = quotes._sources(quotes.parse(spark.createDataFrame(rows, SCHEMA)))
    got = {(r.conv_id, r.turn): (r.out, r.source_conv, r.source_turn) for r in found.collect()}
    assert got[1, 7] == (0, 1, 3) and got[4, 0] == (1, 3, 0)
    assert got == want
