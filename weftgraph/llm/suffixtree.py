"""Language-model scores by a probabilistic suffix tree over words.

Tokens are the blank-separated words with A-Z in lower case, then one end mark.
The tree's root is the distribution of single tokens, (c + 1) / (N + V + 1),
with one share for all unknown words.  Inner states are contexts of up to
``DEPTH`` preceding tokens (the start of a text counts as a token of the
context).  A context is a candidate if it occurs ``sqrt(N) / CONTEXTS`` times;
it is retained if its next-symbol distribution diverges from that of its
longest retained suffix: a Kullback-Leibler divergence of at least ``MIN_KL``
nats that also passes ``MIN_GAIN`` nats over all its occurrences.  Next symbols
are stored that follow it ``sqrt(N) / PAIRS`` times; the others share what the
state leaves.  Distributions are smoothed by absolute discounting: what a state
takes from its own counts is given back to its parent's distribution, so each
sums to one.  A token is scored in the longest retained suffix of what precedes
it.

Sizes.  The text is read once, in blocks of about ``BLOCK_BYTES`` that a task
gathers: each block leaves its distinct words with counts, and its tokens as
places in that list.  The root's counts grow with the corpus and are never
broadcast: blocks look their own words up by one equi-join and get the answers
in a cogroup.  States and stored next symbols grow with the root of the corpus:
there are at most ``DEPTH * CONTEXTS * sqrt(N)`` and ``DEPTH * PAIRS * sqrt(N)``
of them, of 24 bytes, and they are sent to every executor.

Defined results: a null or empty text is the end mark alone; repeated rows are
scored, and learned from, as often as they occur; without training rows every
token has probability 1 (N = V = 0); a null doc_id is in training; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize, shuffles_dropped, small_batches

DEPTH, CONTEXTS, PAIRS = 3, 8, 128
MIN_KL, MIN_GAIN, LEAST, DISCOUNT = 0.01, 10.0, 3, 0.7
BLOCK_BYTES = 16_000_000
#: Tokens that are counted at once: two workers share what an executor's JVM leaves.
PART = 1_000_000
#: Stands for the end of a text among words, and can't be one.
END = " "
NONE = -1
_NULL_ID = -(1 << 63)


# ---- blocks of texts as arrays ----------------------------------------------


def tokenize(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (the last is the end mark), the place of each token in them, one past each text's end."""
    kind = pa.dictionary(pa.int32(), pa.large_string())
    parts, sizes = [], []
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:  # split words take many times a text's bytes
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(chunk.cast(pa.large_string()), "")))
        flat = lists.flatten()
        real = pc.not_equal(flat, "")
        parts.append(flat.filter(real).dictionary_encode())
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        sizes.append(np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(lists)) + 1)
        del lists, flat, real, owner
    coded = pa.chunked_array(parts, kind).unify_dictionaries()
    words = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.large_string())
    ends = np.concatenate(sizes).cumsum() if sizes else np.zeros(0, dtype=np.int64)
    codes = np.full(int(ends[-1]) if len(ends) else 0, len(words), dtype=np.int32)
    inner = np.ones(len(codes), dtype=bool)
    inner[ends - 1] = False
    codes[inner] = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]) if coded.num_chunks else 0
    return pa.concat_arrays([words, pa.array([END], pa.large_string())]), codes, ends


def before(codes: np.ndarray, ends: np.ndarray, steps: int, start: int) -> np.ndarray:
    """What stands so many tokens before each: ``start`` at a text's begin and NONE before that."""
    out = np.full(len(codes), NONE, dtype=np.int64)
    if len(codes) > steps:
        out[steps:] = codes[:-steps]
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for k in range(steps):
        at = begins + k
        out[at[at < ends]] = start if k == steps - 1 else NONE
    return out


BLOCKS = "block string, word string, place int, n long, doc_ids binary, held binary, ends binary, codes binary"


def _blocks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(name: str, rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"block": pa.string(), "word": pa.string(), "place": pa.int32(), "n": pa.int64()} | dict.fromkeys(("doc_ids", "held", "ends", "codes"), pa.binary())
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.array([name] * rows) if c == "block" else pa.nulls(rows, t) for c, t in kinds.items()], names=list(kinds))

    def one(name: str, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        words, codes, ends = tokenize(whole.column("text"))
        whole = whole.select(["doc_id", "held_out"])
        batches.clear()  # the texts
        out = whole.column("held_out").to_numpy().astype(bool)
        learned = np.repeat(~out, np.diff(ends, prepend=0))
        n = np.bincount(codes[learned], minlength=len(words))
        for at in range(0, len(words), 65536):
            part = words[at : at + 65536].cast(pa.string())
            yield row(name, len(part), word=part, place=pa.array(np.arange(at, at + len(part), dtype=np.int32)), n=pa.array(n[at : at + len(part)].astype(np.int64)))
        del words
        ids = pc.fill_null(whole.column("doc_id"), _NULL_ID).to_numpy()
        blobs = {"doc_ids": ids.astype(np.int64), "held": out, "ends": ends.astype(np.int64), "codes": codes}
        yield row(name, 1, n=pa.array([len(ends)], pa.int64()), **{k: pa.array([pa.compress(v.tobytes(), "zstd", asbytes=True)], pa.binary()) for k, v in blobs.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from one(f"{task}-{count}", held)
                count, held, size = count + 1, [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from one(f"{task}-{count}", held)
        pa.default_memory_pool().release_unused()

    return run


# ---- the tree ----------------------------------------------------------------


@dataclass
class Tree:
    """Symbols are numbered by their place in ``symbols``; START is their number, other words None.

    ``levels`` are the candidates of each depth, as sorted keys: the candidate's
    suffix without its oldest token (a place in the level before) times ``base``
    plus that token's number + 1.  ``state`` says which state a candidate is, if
    it is retained; ``rest`` is what a state leaves to its parent.  ``pairs``
    are ``state * base + symbol + 1``, with the state's own share of that symbol.
    """

    symbols: list[str]
    levels: list[np.ndarray]
    state: list[np.ndarray]
    rest: np.ndarray
    parent: np.ndarray
    pairs: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> int:
        return len(self.symbols) + 3

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(sorted_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)

    def places(self, earlier: list[np.ndarray]) -> list[np.ndarray]:
        """The candidate of each depth, or -1; earlier: the tokens one, two, ... before; NONE and words that aren't symbols match nothing."""
        out, at = [], np.zeros(len(earlier[0]) if earlier else 0, dtype=np.int64)
        for keys, token in zip(self.levels, earlier):
            at = self._find(keys, np.where((at >= 0) & (token != NONE), at * self.base + token + 1, -1))
            out.append(at)
        return out

    def states(self, earlier: list[np.ndarray]) -> np.ndarray:
        """The longest retained suffix, -1 for the root."""
        out = np.full(len(earlier[0]) if earlier else 0, -1)
        for state, at in zip(self.state, self.places(earlier)):
            if len(state):
                own = np.where(at >= 0, state[at], -1)
                out = np.where(own >= 0, own, out)
        return out

    def probability(self, state: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(root)), np.ones(len(root))
        while len(state) and (live := state >= 0).any():
            at = self._find(self.pairs, np.where(live & (symbol >= 0), state * self.base + symbol + 1, -1))
            out += np.where(at >= 0, left * (self.share[at] if len(self.share) else 0), 0)
            left = np.where(live, left * self.rest[state], left)
            state = np.where(live, self.parent[state], -1)
        return out + left * root


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index("symbols"))
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), (offsets - offsets[0])[1:]


def _pairs_of(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) for the candidates of the last level: ``context * base + symbol + 1``, of symbols alone, and -1 - context with all that follows it."""
    start, depth = len(tree.symbols), len(tree.levels)

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        both, n = np.unique(np.concatenate(parts), return_counts=True)
        all_of = np.bincount(both // tree.base, weights=n)
        seen, named = np.flatnonzero(all_of), both % tree.base > 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([both[named], -1 - seen])), pa.array(np.concatenate([n[named], all_of[seen].astype(np.int64)]))], names=["key", "n"])

    held, size = [], 0
    for batch in batches:
        own, ends = _sequences(batch)
        at = tree.places([before(own, ends, k + 1, start) for k in range(depth)])[-1]
        held.append(at[at >= 0] * tree.base + own[at >= 0] + 1)
        size += len(held[-1])
        if size > PART:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _grown(tree: Tree, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, totals: np.ndarray, roots: np.ndarray) -> Tree:
    """The tree with those candidates of its last level that diverge.

    context (ascending), symbol, counts: the pairs to be stored; totals: by candidate.
    """
    if not len(context):
        return tree
    # The longest retained suffix of each candidate, level by level.
    longest = np.full(1, -1)
    for keys, state in zip(tree.levels, tree.state):
        above = longest[keys // tree.base]
        longest = np.where(state >= 0, state, above)
    starts = np.flatnonzero(np.diff(context, prepend=-1))
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(context)))
    who, total = context[starts], totals[context[starts]].astype(np.float64)
    parent = tree.probability(above[who][of], symbol, roots[symbol])
    share = (counts - DISCOUNT) / total[of]
    rest = 1 - np.add.reduceat(share, starts)
    p = share + rest[of] * parent
    # Over the stored symbols, and all others as one.
    other, other_parent = (np.maximum(1 - np.add.reduceat(x, starts), 1e-12) for x in (p, parent))
    kl = np.add.reduceat(p * np.log(p / parent), starts) + other * np.log(other / other_parent)
    keep = (kl >= MIN_KL) & (kl * total >= MIN_GAIN)
    number = np.where(keep, len(tree.rest) + keep.cumsum() - 1, -1)
    state = tree.state[-1].copy()
    state[who[keep]] = number[keep]
    stored = keep[of]
    pairs = number[of][stored] * tree.base + symbol[stored] + 1  # numbers rise, and so do symbols in each
    return Tree(tree.symbols, tree.levels, [*tree.state[:-1], state], np.concatenate([tree.rest, rest[keep]]), np.concatenate([tree.parent, above[who][keep]]), np.concatenate([tree.pairs, pairs]), np.concatenate([tree.share, share[stored]]))


def floors(total: int) -> tuple[float, float]:
    """How often a context, and a next symbol in it, must occur."""
    return max(LEAST, total**0.5 / CONTEXTS), max(LEAST, total**0.5 / PAIRS)


def grow(sequences: DataFrame, symbols: list[str], n: np.ndarray, total: int, distinct: int, most: int = DEPTH) -> Tree:
    """The tree of the training rows of sequences(held_out, symbols); symbols with their counts n."""
    train = sequences.where(~F.col("held_out")).select("symbols")
    none = np.zeros(0, dtype=np.int64)
    tree = Tree(symbols, [], [], np.zeros(0), none, none, np.zeros(0))
    roots = (n + 1) / (total + distinct + 1)
    floor, least = floors(total)
    end = symbols.index(END) if END in symbols else NONE
    words = np.append(np.flatnonzero((n >= floor) & (np.arange(len(n)) != end)), len(symbols))[:, None]  # the last: a text's start
    keys = words[:, 0] + 1
    for depth in range(1, most + 1):
        order = np.argsort(keys)
        words, keys = words[order], keys[order].astype(np.int64)
        tree = Tree(symbols, [*tree.levels, keys], [*tree.state, np.full(len(keys), -1)], tree.rest, tree.parent, tree.pairs, tree.share)

        def run(batches: Iterator[pa.RecordBatch], tree: Tree = tree) -> Iterator[pa.RecordBatch]:
            return _pairs_of(tree, batches)

        # As many rows as candidates and pairs to be stored.
        found = train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where((F.col("key") < 0) | (F.col("n") >= least))
        both, k = (c.to_numpy() for c in found.toArrow().columns)
        totals = np.zeros(len(keys), dtype=np.int64)
        totals[-1 - both[both < 0]] = k[both < 0]
        order = np.argsort(both[both >= 0])
        both, k = both[both >= 0][order], k[both >= 0][order].astype(np.float64)
        context, symbol = both // tree.base, both % tree.base - 1
        tree = _grown(tree, context, symbol, k, totals, roots)
        often = (k >= floor) & (symbol != end)
        words = np.column_stack([words[context[often]], symbol[often]])
        if depth == most or not len(words):
            break
        # The oldest token becomes the last part of the key; what is newer is a candidate of this depth, as it occurs as often.
        suffix = tree.places([words[:, -1 - i] for i in range(depth)])[-1]
        words, keys = words[suffix >= 0], (suffix * tree.base + words[:, 0] + 1)[suffix >= 0]
    return tree


# ---- scoring -----------------------------------------------------------------

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held(doc_id: Column, parts: int = 7, out: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == out, F.lit(False))


SEQUENCES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest double, symbols array<int>"


def sequences(blocks: DataFrame, words: DataFrame, symbols: list[str], least: float, total: int, distinct: int) -> DataFrame:
    """Per document its base columns and its tokens as places in symbols (-1: rarer); rest: what these rarer ones add to the base score."""
    known = blocks.where("word is not null").select("block", "word", "place").join(words, "word").select(F.col("block").alias("home"), "place", F.col("n").alias("all"), F.when(F.col("n") >= least, F.col("word")).alias("symbol"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        place, n = right.column("place").to_numpy(), np.zeros(right.num_rows)
        n[place] = right.column("all").to_numpy()
        number = np.full(len(n), NONE, dtype=np.int32)
        names = right.column("symbol").combine_chunks()
        some = pc.is_valid(names).to_numpy(zero_copy_only=False)
        number[place[some]] = pc.index_in(names.filter(pa.array(some)), pa.array(symbols, pa.string())).to_numpy(zero_copy_only=False)
        root = np.log10((n + 1) / (total + distinct + 1))
        for row in left.to_pylist():
            ids, ends = (np.frombuffer(pa.decompress(row[k], row["rows"] * 8, "zstd"), np.int64) for k in ("doc_ids", "ends"))
            out_of, codes = np.frombuffer(pa.decompress(row["held"], row["rows"], "zstd"), bool), np.frombuffer(pa.decompress(row["codes"], int(ends[-1]) * 4, "zstd"), np.int32)
            starts, own = np.concatenate([[0], ends[:-1]]), number[codes]
            base = root[codes]
            sums = [np.add.reduceat(base, starts)]
            base[own >= 0] = 0
            sums = [np.add.reduceat((n > 0)[codes], starts, dtype=np.int64), *sums, np.add.reduceat(base, starts)]
            del base, codes
            columns = [pa.array(ids, mask=ids == _NULL_ID), pa.array(out_of), pa.array(np.diff(ends, prepend=0)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(own))]
            out.append(pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SEQUENCES.split(", ")]))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)

    streams = blocks.where("word is null").select("block", F.col("n").alias("rows"), "doc_ids", "held", "ends", "codes")
    return streams.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(run, SEQUENCES)


def score(found: DataFrame, tree: Tree, roots: np.ndarray, total: int) -> DataFrame:
    """``RESULT`` for ``sequences``; roots are the symbols' probabilities without context."""
    roots = np.append(roots, 1.0)  # of a rarer token the root's part is in ``rest``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ends = _sequences(batch)
            states = tree.states([before(own, ends, k + 1, len(tree.symbols)) for k in range(len(tree.levels))]) if tree.levels else np.full(len(own), -1)
            p = np.log10(tree.probability(states, own, roots[own]))
            sums = np.add.reduceat(p, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0)
            at = batch.schema.get_field_index
            columns = [batch.column(at(c)) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            columns += [pa.array(np.full(len(ends), total)), batch.column(at("base_score")), pa.array(sums + batch.column(at("rest")).to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return found.mapInArrow(run, RESULT)


@dataclass
class Model:
    found: DataFrame
    tree: Tree
    roots: np.ndarray
    total: int
    distinct: int


def learn(docs: DataFrame, parts: int = 7, out: int = 2, block_bytes: int = BLOCK_BYTES) -> Model:
    small_batches(docs.sparkSession, 512)
    with shuffles_dropped(docs.sparkSession):
        return _learn(docs, parts, out, block_bytes)


def _learn(docs: DataFrame, parts: int, out: int, block_bytes: int) -> Model:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id"), parts, out).alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks = materialize(plain.mapInArrow(_blocks(block_bytes), BLOCKS), "suffixtree-blocks")
    words = materialize(blocks.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "suffixtree-words")
    size = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()  # words of held-out rows alone have 0
    total, distinct = size["n"] or 0, size["v"]
    least = floors(total)[1]
    frequent = sorted(zip(*(c.to_pylist() for c in words.where(F.col("n") >= least).toArrow().columns)))  # at most PAIRS * sqrt(total) words
    symbols, n = [w for w, _ in frequent], np.array([x for _, x in frequent], dtype=np.float64)
    found = materialize(sequences(blocks, words, symbols, least, total, distinct), "suffixtree-sequences")
    discard(blocks)
    discard(words)
    return Model(found, grow(found, symbols, n, total, distinct), (n + 1) / (total + distinct + 1), total, distinct)


def language_model(docs: DataFrame, parts: int = 7, out: int = 2) -> DataFrame:
    """Every document's scores under the model of those that aren't held out."""
    model = learn(docs, parts, out)
    return score(model.found, model.tree, model.roots, model.total)
