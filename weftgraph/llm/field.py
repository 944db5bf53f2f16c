"""The field of ``toxicity``: features, marginals, learning.

Learning needs several times the memory of its sample, and what a long-lived
process once took it seldom gives back.  ``fit_apart`` therefore learns in a
process of its own, which runs this file alone: it may import no more of the
package, and no Spark.
"""

from __future__ import annotations

import os
import pickle
import re
import subprocess
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np

BITS = 16
WINDOW, WINDOWS = 48, 30_000
_TOKEN = re.compile("[^\x20\x09-\x0d]+")
#: Signs that don't belong to a word at its ends.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¿¡"


def bare(token: str) -> str:
    """A token without case and the signs around it."""
    return token.strip(SIGNS).lower()


_MASK = (1 << BITS) - 1
_LENGTHS = [crc32(b"%d" % n, 11) & _MASK for n in range(13)]
_SHAPES = {name: crc32(name.encode(), 12) & _MASK for name in ("upper", "title", "digit", "lower", "bias")}


def _slots(token: str) -> list[int]:
    """Places of a token's features in the weights."""
    word = bare(token).encode("utf-8", "surrogatepass")
    n = len(word)
    if token.islower():
        shape = "lower"
    else:
        shape = "upper" if token.isupper() else "title" if token[:1].isupper() else "digit" if any(map(str.isdigit, token)) else "lower"
    out = [crc32(word, 1) & _MASK, crc32(word[-3:], 2) & _MASK, _LENGTHS[n if n < 12 else 12], _SHAPES[shape], _SHAPES["bias"]]
    for k in range(3, min(8, n)):
        out.append(crc32(word[:k], k) & _MASK)
    return out


# ---- marginals ---------------------------------------------------------------


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray, block: int = 256) -> np.ndarray:
    """P(label 1) of each token.  unary: score of label 1 against 0; first: where a text begins; trans: 2 x 2 scores.

    The recursion's 2 x 2 matrices are multiplied inside blocks of tokens, all
    blocks at once; a text's first token forgets what stands before it.
    """
    n = len(unary)
    if not n:
        return np.zeros(0)
    rows = -(-n // block)
    size = rows * block
    emit = np.ones((size, 2))
    clipped = np.clip(unary, -40, 40)
    high = np.maximum(clipped, 0)
    emit[:n, 0], emit[:n, 1] = np.exp(-high), np.exp(clipped - high)
    new = np.ones(size, dtype=bool)
    new[:n] = first
    last = np.ones(size, dtype=bool)
    last[: n - 1] = first[1:]
    t = np.exp(trans - trans.max())
    step = np.where(new[:, None, None], 1.0, t[None]) * emit[:, None, :]

    def scan(mats: np.ndarray) -> np.ndarray:
        """Row vectors before-times-mats for each place, normalised; mats: (size, 2, 2), entry [i, j] from i to j."""
        m = mats.reshape(rows, block, 2, 2)
        inside = np.empty_like(m)
        inside[:, 0] = m[:, 0]
        for k in range(1, block):
            a, b = inside[:, k - 1], m[:, k]
            c = np.empty_like(a)
            for i in (0, 1):
                for j in (0, 1):
                    c[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
            inside[:, k] = c / c.sum(axis=(1, 2), keepdims=True)
        start = np.empty((rows, 2))
        x, y = 0.5, 0.5
        for r, (p, q, u, v) in enumerate(inside[:, -1].reshape(rows, 4).tolist()):
            start[r] = x, y
            x, y = x * p + y * u, x * q + y * v
            s = x + y
            x, y = x / s, y / s
        out = start[:, 0, None, None] * inside[:, :, 0] + start[:, 1, None, None] * inside[:, :, 1]
        return (out / out.sum(axis=2, keepdims=True)).reshape(size, 2)

    alpha = scan(step)
    # Backwards: beta[i] = sum over j of t[i, j] emit[i + 1, j] beta[i + 1, j]; after a text's last token it is even.
    back = np.ones((size, 2, 2))
    follows = (t[None] * emit[1:, None, :]).transpose(0, 2, 1)
    back[:-1] = np.where(last[:-1, None, None], 1.0, follows)
    beta = scan(np.ascontiguousarray(back[::-1]))[::-1]
    both = alpha[:n] * beta[:n]
    return both[:, 1] / both.sum(axis=1)


# ---- learning ----------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    weights: np.ndarray
    trans: np.ndarray
    scale: np.ndarray  # of the logistic regression: bias and three weights

    def unary(self) -> Callable[[str], float]:
        weight = self.weights.tolist().__getitem__
        return lambda token: sum(map(weight, _slots(token)))


def _marks(texts: list[str], labels: list[int]) -> set[str]:
    """Words (after a "=") and first letters of words that toxic rows have in more different neighbourhoods than chance explains."""
    place: dict[str, int] = {}
    whole, count = [0, 0], [np.zeros(0, dtype=np.int64)] * 2
    for label in (1, 0):  # what never stands in toxic rows can't be a mark, and isn't kept
        different, keys, pairs = [], [], []
        for text, y in zip(texts, labels):
            if y != label:
                continue
            found = [bare(t) for t in _TOKEN.findall(text)]
            around = [hash(x) for x in zip(["", *found], [*found[1:], ""])]
            different.append(np.unique(np.array([hash((w, p)) for w, p in zip(found, around) if len(w) > 2], dtype=np.int64)))
            own = []
            for w, p in zip(found, around):
                if len(w) > 2:
                    for key in ("=" + w, *(w[:k] for k in (4, 5, 6) if len(w) > k)):
                        at = place.setdefault(key, len(place)) if label else place.get(key)
                        if at is not None:
                            own.append((at, p))
            if own:
                keys.append(np.array([k for k, _ in own], dtype=np.int32))
                pairs.append(np.array([p for _, p in own], dtype=np.int64))
        whole[label] = len(np.unique(np.concatenate(different))) if different else 0
        if keys:
            k, p = np.concatenate(keys), np.concatenate(pairs)
            order = np.lexsort((p, k))
            k, p = k[order], p[order]
            new = np.append(True, (np.diff(k) != 0) | (np.diff(p) != 0))
            count[label] = np.bincount(k[new], minlength=len(place))
    hits, misses = count[1], np.pad(count[0], (0, len(place) - len(count[0])))
    share = max(whole[1], 1) / max(sum(whole), 1)
    limit = np.log(max(1, len(place)) / 0.01)
    names, found = list(place), set()
    for i in np.flatnonzero(hits > 2):
        n = int(hits[i] + misses[i])
        rate = hits[i] / n
        if rate > max(0.9, share) and n * (rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0)) > limit:
            found.add(names[i])
    return found


def fit(texts: list[str], labels: list[int], rate: float, steps: int = 400, seed: int = 1, traits_of: Callable | None = None) -> Field | None:
    """rate: the share of label 1 among all labelled rows."""
    both = list(dict.fromkeys(zip(texts, labels)))
    texts, labels = [t for t, _ in both], [y for _, y in both]
    if not 0 < sum(labels) < len(labels):
        return None
    marks = _marks(texts, labels)
    rng = np.random.default_rng(seed)
    cache: dict[str, list[int]] = {}
    windows, gold = [], []
    for text, y in zip(texts, labels):
        found = _TOKEN.findall(text)
        tags = [y and int(("=" + (w := bare(t))) in marks or any(w[:k] in marks for k in (4, 5, 6) if len(w) > k)) for t in found]
        starts, end = [int(rng.integers(max(1, len(found) - WINDOW + 1)))] if found else [], 0
        for i, tag in enumerate(tags):
            if tag and i >= end:  # the windows before don't hold this mark
                starts.append(max(end, i - int(rng.integers(WINDOW))))
                end = starts[-1] + WINDOW
        for s in starts:
            windows.append(found[s : s + WINDOW])
            gold.append(tags[s : s + WINDOW])
    if len(windows) > WINDOWS:
        picked = np.sort(rng.permutation(len(windows))[:WINDOWS])
        windows, gold = [windows[i] for i in picked], [gold[i] for i in picked]
    width = max(map(len, map(_slots, ["abcdefghijkl"])))
    n = len(windows)
    slots = np.full((n, WINDOW, width), 1 << BITS, dtype=np.int32)
    live, tags = np.zeros((n, WINDOW), dtype=bool), np.zeros((n, WINDOW), dtype=np.int8)
    for r, (w, g) in enumerate(zip(windows, gold)):
        for i, t in enumerate(w):
            at = cache.get(t)
            if at is None:
                at = cache[t] = _slots(t)
            slots[r, i, : len(at)] = at
        live[r, : len(w)], tags[r, : len(w)] = True, g
    del windows, gold, cache
    weights, trans = np.zeros((1 << BITS) + 1), np.zeros((2, 2))
    sq, sq_t = np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(max(1, -(-steps * 256 // n))):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = order[at : at + 256]
            gw, gt = _gradient(slots[pick], live[pick], tags[pick], weights, trans)
            gw += 1e-4 * weights
            gw[-1] = 0
            sq += gw * gw
            sq_t += gt * gt
            weights -= 0.3 * gw / np.sqrt(sq)
            trans -= 0.1 * gt / np.sqrt(sq_t)
    del slots, live, tags
    field = Field(weights[:-1].astype(np.float32), trans, np.zeros(4))
    known: dict[str, float] = {}
    traits = np.array([(traits_of or document_traits)(p) for at in range(0, len(texts), 16) for p, _ in _scored(field, texts[at : at + 16], known)])
    y = np.array(labels, dtype=float)
    cost = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    x = np.column_stack([np.ones(len(y)), traits])
    scale = _logistic(x, y, cost)
    return Field(field.weights, trans, scale)


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """The weights of least penalised cost; x: a column of ones, then the traits.

    Newton's steps, halved until the cost falls: where classes are all but
    apart, whole ones overshoot from one side to the other and never settle.
    The cost is convex, so what no step lowers is its minimum.
    """
    weights, penalty = np.zeros(x.shape[1]), np.append(0, np.full(x.shape[1] - 1, ridge))

    def total(w: np.ndarray) -> float:
        z = (x * w).sum(axis=1)
        return float((cost * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

    now = total(weights)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip((x * weights).sum(axis=1), -500, 500)))
        g = (x * (cost * (p - y))[:, None]).sum(axis=0) + penalty * weights
        h = np.einsum("ni,n,nj->ij", x, cost * p * (1 - p), x) + np.diag(np.append(1e-6, penalty[1:]))
        move, step = np.linalg.solve(h, g), 1.0
        while step > 1e-9 and not (after := total(weights - step * move)) < now:
            step /= 2
        if step <= 1e-9 or now - after < 1e-12 * abs(now):
            break
        weights, now = weights - step * move, after
    return weights


def _gradient(slots: np.ndarray, live: np.ndarray, tags: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log likelihood of windows."""
    n, length = live.shape
    u = np.clip(weights[slots].sum(axis=2), -40, 40)
    emit = np.stack([np.ones_like(u), np.exp(u)], axis=2)
    t = np.exp(trans)
    alpha, beta = np.empty((n, length, 2)), np.empty((n, length, 2))
    alpha[:, 0] = emit[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, length):
        a = alpha[:, k - 1]
        alpha[:, k] = np.stack([a[:, 0] * t[0, j] + a[:, 1] * t[1, j] for j in (0, 1)], axis=1) * emit[:, k]
        alpha[:, k] /= alpha[:, k].sum(axis=1, keepdims=True)
    beta[:, -1] = 1
    for k in range(length - 2, -1, -1):
        b = beta[:, k + 1] * emit[:, k + 1]
        step = np.stack([t[i, 0] * b[:, 0] + t[i, 1] * b[:, 1] for i in (0, 1)], axis=1)
        beta[:, k] = np.where(live[:, k + 1, None], step / step.sum(axis=1, keepdims=True), 1)
    p = alpha * beta
    p = p[:, :, 1] / p.sum(axis=2)
    diff = np.where(live, p - tags, 0)
    gw = np.bincount(slots.ravel(), weights=np.repeat(diff.ravel(), slots.shape[2]), minlength=len(weights)) / n
    both = live[:, 1:]
    pair = alpha[:, :-1, :, None] * t[None, None] * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    gt = (pair * both[:, :, None, None]).sum(axis=(0, 1))
    for i in (0, 1):
        for j in (0, 1):
            gt[i, j] -= ((tags[:, :-1] == i) & (tags[:, 1:] == j) & both).sum()
    return gw, gt / n


# ---- documents ---------------------------------------------------------------


def document_traits(p: np.ndarray) -> tuple[float, float, float]:
    """Log of expected toxic tokens, log odds that there is any, and their share."""
    if not len(p):
        return -7.0, -7.0, 0.0
    none = float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
    some = -np.expm1(none)
    return float(np.log(p.sum() + 1e-3)), float(np.clip(np.log(max(some, 1e-9)) - none, -7, 7)), float(np.sqrt(p.mean()))


def _scored(field: Field, texts: list[str | None], known: dict[str, float]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Marginals and tokens of each text."""
    tokens = [_TOKEN.findall(t) if t else [] for t in texts]
    flat: list[float] = []
    unary = field.unary()
    for found in tokens:
        for t in found:
            s = known.get(t)
            if s is None:
                if len(known) > 200_000:
                    known.clear()
                s = unary(t)
                if len(t) < 64:
                    known[t] = s
            flat.append(s)
    lengths = np.array([len(f) for f in tokens])
    ends = lengths.cumsum()
    first = np.zeros(len(flat), dtype=bool)
    first[(ends - lengths)[lengths > 0]] = True
    p = marginals(np.array(flat), first, field.trans)
    for end, n, found in zip(ends, lengths, tokens):
        yield p[end - n : end], found


# ---- apart -------------------------------------------------------------------


def fit_apart(texts: list[str], labels: list[int], rate: float) -> Field | None:
    """``fit``, in a process of its own."""
    import inspect

    command = [sys.executable, "-c", inspect.getsource(sys.modules[fit.__module__])]
    run = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=os.environ | {"PYTHONPATH": os.pathsep.join(p or os.getcwd() for p in sys.path)})
    with run:
        try:
            pickle.dump((texts, labels, rate), run.stdin, protocol=5)
            run.stdin.close()
            found = run.stdout.read()
        except BaseException:
            run.kill()
            raise
    if run.returncode:
        raise RuntimeError(f"the process that fits the field ended with {run.returncode}")
    made = pickle.loads(found)
    return made and Field(*made)


if __name__ == "__main__":
    _out = os.dup(1)
    os.dup2(2, 1)  # the result alone goes to the pipe
    _made = fit(*pickle.load(sys.stdin.buffer))
    with os.fdopen(_out, "wb") as _f:
        pickle.dump(_made and (_made.weights, _made.trans, _made.scale), _f, protocol=5)
