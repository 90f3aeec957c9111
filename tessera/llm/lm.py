"""Language-model scoring: a log-bilinear model of word classes, trained in numpy by noise-contrastive estimation.

Counts of all training tokens give the add-one unigram base. The frequent words are classes of their own; the others
fall into classes by how they end, so that unseen words have a class too. Counts of neighbouring classes over all
training texts are what the model of classes is trained on. Then every training word of OWN occurrences or more gets a
context vector and an output vector of its own, where its occurrences (or counts of them) meet: the class after is predicted by the
word's vector, the word within its class by its output vector and the class before. Both factors are normalised over
all classes and over all words of the class. Rarer words keep their class's vector and their add-one share.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SOLID, Words, blocks, mix, small_batches, stash

#: Classes: the end token, single frequent words, and classes of the other words.
HEAD, TAILS = 767, 256
K = 1 + HEAD + TAILS
#: Training occurrences from which a word has vectors of its own.
OWN = 3
#: What is added, times TAILS, to the tail class of an occurrence: its word's count is not broadcast; its word is frequent.
RARE, HOT = 1, 2
#: An occurrence of a word of the tail classes: row * 4 + 2 (count not broadcast) + 1 (learnt), class before, class after.
PLACE = np.dtype([("row", "<i8"), ("before", "<i2"), ("after", "<i2")])
#: How often a class stands after a word, or, K higher, before it.
SEEN = np.dtype([("cls", "<i2"), ("n", "<i4")])
#: The end token's key among the hashes of words.
END = np.int64(-(2**63))


def tail_class(w: Words) -> np.ndarray:
    """0..TAILS-1 from the last three bytes of each word."""
    last = w.buf[w.end - 1].astype(np.uint64)
    mid = w.buf[np.maximum(w.end - 2, w.start)].astype(np.uint64)
    third = w.buf[np.maximum(w.end - 3, w.start)].astype(np.uint64)
    return (mix(last | mid << np.uint64(8) | third << np.uint64(16)) % np.uint64(TAILS)).astype(np.int64)


def _keys(w: Words) -> np.ndarray:
    """Hash of each word as a signed 64-bit key, never END."""
    h = w.hash.view(np.int64).copy()
    h[h == END] = 1
    return h


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (key, tail, n): the words of a batch, each with its class and count, and the ends of texts."""
    for b in batches:
        keys, tails, n = [np.array([END])], [np.array([0])], [np.array([b.num_rows])]
        for _, part in blocks(b.column(0).to_pylist()):
            w = Words(part, SOLID)
            k, first, c = np.unique(_keys(w), return_index=True, return_counts=True)
            keys.append(k)
            tails.append(tail_class(w)[first] if len(k) else np.zeros(0, dtype=np.int64))
            n.append(c)
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(n)).astype(np.int64)
        tail = np.zeros(len(k), dtype=np.int32)
        tail[at] = np.concatenate(tails)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(tail), pa.array(total)], ["key", "tail", "n"])


class Table:
    """Sorted keys with a value each; finds many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table; -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def find(self, keys: np.ndarray, missing) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], missing)


def _classes(w: Words, heads: Table) -> np.ndarray:
    return np.where((c := heads.find(_keys(w), -1)) >= 0, c, 1 + HEAD + tail_class(w))


def _with_ends(w: Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of all texts, each text closed by `end`; and the place of each end."""
    ends = w.first[1:] + np.arange(len(w.first) - 1)
    out = np.empty(len(values) + len(ends), dtype=values.dtype)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside], out[ends] = values, end
    return out, ends


def _pairs(held):
    """(text) to (before, after, n): counts of neighbouring classes; a text starts after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K * K, dtype=np.int64)
        for b in batches:
            for _, part in blocks(b.column(0).to_pylist()):
                w = Words(part, SOLID)
                c, _ = _with_ends(w, _classes(w, held.value), 0)
                before = np.concatenate([[0], c[:-1]])
                total += np.bincount(before * K + c, minlength=K * K)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            p = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array((p // K).astype(np.int32)), pa.array((p % K).astype(np.int32)), pa.array(total[p])], ["before", "after", "n"])

    return run


def train_nce(pairs: np.ndarray, counts: np.ndarray, dims: int = 48, steps: int = 300) -> np.ndarray:
    """log10 P(after | before), K x K, of the model that train_vectors() gives."""
    return _table(*train_vectors(pairs, counts, dims, steps))


def _table(h: np.ndarray, r: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logits = h @ r.T + bias
    logits -= logits.max(1, keepdims=True)
    return ((logits - np.log(np.exp(logits).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)


def train_vectors(pairs: np.ndarray, counts: np.ndarray, dims: int = 48, steps: int = 300, noise: float = 64.0, rate: float = 0.05, prior: float = 0.3, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors, output vectors and biases of a log-bilinear model of classes: the context vector of the class
    before, through a bilinear form (already applied), against the vector of the class after, plus a bias.

    pairs: (before, after, count) rows over the whole corpus. NCE tells each true pair from `noise` noise pairs drawn by
    class counts; every step goes over all counted pairs, weighted by their counts, and over the expected noise in place
    of draws, so nothing depends on how many pairs are drawn as a corpus grows. The gradient is a few matrix products of
    K x K; steps are scaled by its running moments. The bias starts at the log share of the class, so that the untrained
    model is the class unigram; `prior` pulls vectors to zero by so many counts.
    """
    k = len(counts)
    rng = np.random.default_rng(seed)
    share = ((counts + 1) / (counts + 1).sum()).astype(np.float32)
    seen = np.zeros((k, k), dtype=np.float32)
    seen[pairs[:, 0], pairs[:, 1]] = pairs[:, 2]
    both = seen + seen.sum(1, keepdims=True) * (noise * share)
    eye, log_share = np.eye(dims, dtype=np.float32), np.log(share)
    odds = log_share + np.float32(np.log(noise))
    q, r = (rng.normal(0, 0.1, (k, dims)).astype(np.float32) for _ in range(2))
    at = [q, r, eye.copy(), log_share.copy()]
    mean, square = [np.zeros_like(x) for x in at], [np.zeros_like(x) for x in at]
    for t in range(1, steps + 1):
        q, r, c, bias = at
        h = q @ c
        g = seen - both / (1 + np.exp(-np.clip(h @ r.T + (bias - odds), -30, 30)))
        dh = g @ r
        slopes = [dh @ c.T - prior * q, g.T @ h - prior * r, q.T @ dh - prior * (c - eye), g.sum(0)]
        step = rate * (1 - 0.9 * t / steps)
        for x, gx, m, v in zip(at, slopes, mean, square, strict=True):
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x += step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-3)
    q, r, c, bias = at
    return q @ c, r, bias


def _climb(start: np.ndarray, value, solve, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the best vector of some damped Newton steps from zero, and what `value` says of it: value gives
    objective, gradient and a dense matrix of rows; solve turns gradients into steps. A step that does not better the
    objective is not taken."""
    best, (gain, gradient, dense) = start, value(start)
    way, length = solve(gradient), np.ones((len(start), 1), dtype=np.float32)
    for _ in range(tries):
        got = best + length * way
        new, gradient, there = value(got)
        good = (new > gain)[:, None]
        best, dense, gain = np.where(good, got, best), np.where(good, there, dense), np.maximum(new, gain)
        way, length = np.where(good, solve(gradient), way), np.where(good, np.float32(1), length / 4)
    return best, dense


def _spread(vectors: np.ndarray, share: np.ndarray, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the (centred) second moment of vectors by their share."""
    moment, mean = (vectors * share[:, None]).T @ vectors, share @ vectors
    e, u = np.linalg.eigh(moment - np.outer(mean, mean) if centred else moment)
    return np.maximum(e, 0), u


def _context_fit(seen: np.ndarray, base: np.ndarray, r: np.ndarray, spread=None, prior: float = 4.0, tries: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Each word's own vector, fitted to the classes seen after it (words x classes), with the class's vector as prior; and
    what context_vectors() gives. base: ln P(class | class of the words)."""
    n, total = seen.sum(1, keepdims=True), seen @ r
    e, u = _spread(r, np.exp(base), True) if spread is None else spread

    def value(d):
        x = d @ r.T
        w = x + base
        top = w.max(1, keepdims=True)
        w -= top
        np.exp(w, out=w)
        z = w.sum(1, keepdims=True)
        norm = top + np.log(z)
        x -= norm
        return (d * total).sum(1) - (n * norm)[:, 0] - prior / 2 * (d * d).sum(1), total - n * (w @ r / z) - prior * d, x

    return _climb(np.zeros_like(total), value, lambda g: (g @ u / (n * e + prior)) @ u.T, tries)


def context_vectors(seen: np.ndarray, base: np.ndarray, r: np.ndarray, spread=None) -> np.ndarray:
    """ln P(class | word) - ln P(class | the word's class), words x classes, by each word's own vector. Every row is
    normalised over all classes."""
    return _context_fit(seen, base, r, spread)[1]


def _biased(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones((len(h), 1), dtype=h.dtype)], 1)


def _output_fit(seen: np.ndarray, around: np.ndarray, h: np.ndarray, spread=None, noise: float = 16.0, prior: float = 4.0, tries: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Each word's own vector and bias by NCE, with the expected noise of its share in place of drawn noise; and what
    output_vectors() gives. seen: counts of classes before the words; around: the same of all words of their class."""
    n = seen.sum(1, keepdims=True)
    h, share = _biased(h), around / max(around.sum(), 1)
    false = np.float32(noise) * n * share.astype(np.float32)
    both = seen + false
    e, u = _spread(h, share, False) if spread is None else spread
    e = e * np.float32(noise / (1 + noise))

    def value(d):
        x = d @ h.T
        s = x - np.float32(np.log(noise))
        t = np.abs(s)
        np.negative(t, out=t)
        np.exp(t, out=t)
        # ln(1 + e^-s) is what a true pair loses, and s more what a false one does
        lost = np.log1p(t) - np.minimum(s, 0)
        gain = -np.einsum("ij,ij->i", both, lost) - np.einsum("ij,ij->i", false, s)
        true = np.where(s >= 0, np.float32(1), t) / (1 + t)
        true *= both
        return gain - prior / 2 * (d * d).sum(1), (seen - true) @ h - prior * d, x

    return _climb(np.zeros((len(seen), h.shape[1]), dtype=np.float32), value, lambda g: (g @ u / (n * e + prior)) @ u.T, tries)


def output_vectors(seen: np.ndarray, around: np.ndarray, h: np.ndarray, spread=None) -> np.ndarray:
    """ln of what a word's weight within its class is multiplied by after each class, words x classes, by each word's own
    vector and bias."""
    return _output_fit(seen, around, h, spread)[1]


def _gathered(batches: Iterator[pa.RecordBatch], read, size: int = 500_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays that read(batch) gives, of about `size` occurrences together."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(read(b))
        if held and (b is None or sum(len(x[0]) for x in held) >= size):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []


def _blobs(data: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Runs of data that start at first, as binary values, some at a time: (which, values)."""
    for i in range(0, len(first), 50_000):
        at = first[i : i + 50_000]
        last = first[i + 50_000] if i + 50_000 < len(first) else len(data)
        offsets = (np.append(at, last) - at[0]) * data.dtype.itemsize
        yield np.arange(i, i + len(at)), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at[0] : last].tobytes())])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, own, before, after) lists of training rows to (own, key, counts): how often each class stands after and, K
    higher, before each frequent word of the tail classes."""

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        own = b.column(1).flatten().to_numpy()
        mine = np.flatnonzero(own // TAILS == HOT)
        return (b.column(0).flatten().to_numpy()[mine], own[mine] % TAILS, *(b.column(i).flatten().to_numpy()[mine] for i in (2, 3)))

    for key, own, before, after in _gathered(batches, read):
        key, own = np.concatenate([key, key]), np.concatenate([own, own])
        cls = np.concatenate([after.astype(np.int16), before.astype(np.int16) + np.int16(K)])
        order = np.lexsort((cls, key, own))
        key, own, cls = key[order], own[order], cls[order]
        cell = _starts(key, own, cls)
        data = np.empty(len(cell), dtype=SEEN)
        data["cls"], data["n"] = cls[cell], np.diff(np.append(cell, len(key)))
        first = _starts(key[cell], own[cell])
        for i, blob in _blobs(data, first):
            at = cell[first[i]]
            yield pa.RecordBatch.from_arrays([pa.array(own[at].astype(np.int32)), pa.array(key[at]), blob], ["own", "key", "counts"])


def _hot_vectors(held):
    """(own, key, counts) sorted by them to (key, row, vec, w): each word's context vector, its norm, its output vector and
    bias; then rows with row = -1 - (tail class * K + class before): what the words' vectors add to the weight of their class
    there. A word's counts are summed as they come, so that a task holds no more of a frequent word than of a rare one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, h, r, around = held.value
        weight: dict[int, np.ndarray] = {}
        spreads: dict[int, tuple] = {}

        def fitted(t: int, key: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            if t not in spreads:
                spreads.clear()
                spreads[t] = _spread(r, np.exp(table[1 + HEAD + t]), True), _spread(_biased(h), around[t] / max(around[t].sum(), 1), False)
            d, x = _context_fit(seen[:, :K].astype(np.float32), table[1 + HEAD + t], r, spreads[t][0])
            e, y = _output_fit(seen[:, K:].astype(np.float32), around[t], h, spreads[t][1])
            norm = (d @ r.T - x).mean(1, keepdims=True)
            vec = [v.tobytes() for v in np.concatenate([d, norm, e], 1).astype(np.float32)]
            weight[t] = weight.get(t, 0) + (seen[:, :K].sum(1) + 1) @ np.expm1(y.astype(np.float64))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), dtype=np.int64)), pa.array(vec, pa.binary()), pa.nulls(len(key), pa.float64())], ["key", "row", "vec", "w"])

        last: tuple[int, int, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            own, key, blobs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            first = np.append(_starts(own, key), len(key))
            for t in np.unique(own[first[:-1]]):
                words = np.flatnonzero(own[first[:-1]] == t)
                for i in range(0, len(words), 512):
                    a, z = first[words[i]], first[min(words[min(i + 511, len(words) - 1)] + 1, len(first) - 1)]
                    data = np.frombuffer(b"".join(blobs[a:z]), dtype=SEEN)
                    names = key[first[words[i : i + 512]]]
                    rows = np.repeat(np.arange(a, z), [len(x) // SEEN.itemsize for x in blobs[a:z]])
                    line = np.searchsorted(first[words[i : i + 512]], rows, side="right") - 1
                    seen = np.bincount(line * 2 * K + data["cls"], weights=data["n"], minlength=len(names) * 2 * K).reshape(-1, 2 * K)
                    # the last word may go on in what comes next
                    if last is not None:
                        if last[0] == t and last[1] == names[0]:
                            seen[0] += last[2]
                        else:
                            yield fitted(last[0], np.array([last[1]]), last[2][None])
                    last = int(t), int(names[-1]), seen[-1].copy()
                    if len(names) > 1:
                        yield fitted(int(t), names[:-1], seen[:-1])
        if last is not None:
            yield fitted(last[0], np.array([last[1]]), last[2][None])
        for t, w in weight.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(K, dtype=np.int64)), pa.array(-1 - (t * K + np.arange(K))), pa.nulls(K, pa.binary()), pa.array(w)], ["key", "row", "vec", "w"])

    return run


def _occurrences(hot: bool):
    """(row, held_out, key, own, before, after) to (own, key, places): the occurrences of words of the tail classes, of frequent
    ones or of the others, those of one word together, as many as are gathered at once."""

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        own = b.column(3).flatten().to_numpy()
        place = np.empty(len(own), dtype=PLACE)
        row = b.column(0).to_numpy() * 4 + ~b.column(1).to_numpy(zero_copy_only=False)
        place["row"] = np.repeat(row, np.diff(b.column(2).offsets.to_numpy())) + 2 * (own // TAILS == RARE)
        place["before"], place["after"] = b.column(4).flatten().to_numpy(), b.column(5).flatten().to_numpy()
        mine = np.flatnonzero((own // TAILS == HOT) == hot)
        return b.column(2).flatten().to_numpy()[mine], own[mine] % TAILS, place[mine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, place in _gathered(batches, read):
            order = np.lexsort((key, own))
            key, own, place = key[order], own[order], place[order]
            first = _starts(own, key)
            for i, blob in _blobs(place, first):
                yield pa.RecordBatch.from_arrays([pa.array(own[first[i]].astype(np.int32)), pa.array(key[first[i]]), blob], ["own", "key", "places"])

    return run


def _last_run(key: np.ndarray) -> int:
    """Where the last run of equal keys starts; 0 for none."""
    other = np.flatnonzero(key != key[-1]) if len(key) else key
    return int(other[-1]) + 1 if len(other) else 0


def _fitted(held):
    """(own, key, places), all of a word together and sorted, to (row, k, base, score): what the words' counts and own
    vectors add to rows; and under -1 - (tail class * K + class before), what they add to the weight of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, h, r, around = held.value
        weight: dict[int, np.ndarray] = {}
        spreads: dict[int, tuple] = {}

        def fit(b: pa.RecordBatch) -> list[np.ndarray]:
            own, key, blobs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            place = np.frombuffer(b"".join(blobs), dtype=PLACE)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            word = np.repeat(np.cumsum(new) - 1, [len(x) // PLACE.itemsize for x in blobs])
            own = own[new]
            learnt, rare = (place["row"] & 1).astype(np.float32), (place["row"] & 2) > 0
            n = np.bincount(word, weights=learnt, minlength=len(own))
            base = np.where(rare, np.log10(n + 1)[word], 0.0)
            score = base.copy()
            ends = np.searchsorted(word, np.arange(len(own) + 1))
            for t in np.unique(own):
                if t not in spreads:
                    spreads.clear()
                    spreads[t] = _spread(r, np.exp(table[1 + HEAD + t]), True), _spread(_biased(h), around[t] / max(around[t].sum(), 1), False)
                who = np.flatnonzero((own == t) & (n >= OWN))
                for i in range(0, len(who), 512):
                    some = who[i : i + 512]
                    size = ends[some + 1] - ends[some]
                    at = np.repeat(ends[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    line, before, after = np.repeat(np.arange(len(some)), size), place["before"][at].astype(np.int64), place["after"][at].astype(np.int64)
                    count = lambda c: np.bincount(line * K + c, weights=learnt[at], minlength=len(some) * K).reshape(-1, K).astype(np.float32)  # noqa: E731, B023
                    x = context_vectors(count(after), table[1 + HEAD + t], r, spreads[t][0])
                    y = output_vectors(count(before), around[t], h, spreads[t][1])
                    score[at] += (x[line, after] + y[line, before]) / np.log(10)
                    weight[t] = weight.get(t, 0) + (n[some] + 1) @ np.expm1(y.astype(np.float64))
            return [place["row"] >> 2, rare & (n[word] > 0), base, score]

        def merged(parts: list) -> list[np.ndarray]:
            rows, back = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            return [rows, *(np.bincount(back, weights=np.concatenate([x[i] for x in parts])).astype(np.float64) for i in (1, 2, 3))]

        def out(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(x[0]), 50_000):
                row, k, base, score = (y[i : i + 50_000] for y in x)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(k.astype(np.int64)), pa.array(base), pa.array(score)], ["row", "k", "base", "score"])

        waiting, size, enough = [], 0, 2 << 20
        sums: list[list[np.ndarray]] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                waiting.append(b)
                size += b.nbytes
            if waiting and (b is None or size >= enough):
                whole = pa.concat_batches(waiting)
                key = whole.column(1).to_numpy()
                # the last word may go on in the next batch
                cut = len(key) if b is None else _last_run(key)
                if cut:
                    sums.append(merged([fit(whole.slice(0, cut))]))
                waiting = [whole.slice(cut)] if cut < len(key) else []
                size = sum(x.nbytes for x in waiting)
                enough = max(2 << 20, 2 * size)
            if sum(len(x[0]) for x in sums) > 500_000:
                sums = [merged(sums)]
                if len(sums[0][0]) > 250_000:
                    yield from out(sums.pop())
        if sums:
            yield from out(merged(sums))
        for t, w in weight.items():
            zero = np.zeros(K)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - (int(t) * K + np.arange(K))), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(w)], ["row", "k", "base", "score"])

    return run


def _hot_scores(held):
    """(places, vec) of frequent words to (row, k, base, score): what the words' own vectors add to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, r = held.value
        dims = r.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            blobs = b.column(0).to_pylist()
            place = np.frombuffer(b"".join(blobs), dtype=PLACE)
            word = np.repeat(np.arange(len(blobs)), [len(x) // PLACE.itemsize for x in blobs])
            own = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float32).reshape(len(blobs), -1)
            score = np.zeros(len(place))
            for i in range(0, len(place), 20_000):
                some = slice(i, i + 20_000)
                v, before, after = own[word[some]], place["before"][some], place["after"][some]
                x = np.einsum("ij,ij->i", v[:, :dims], r[after]) - v[:, dims]
                y = np.einsum("ij,ij->i", v[:, dims + 1 :], h[before])
                score[some] = (x + y).astype(np.float64) / np.log(10)
            rows, back = np.unique(place["row"] >> 2, return_inverse=True)
            zero = np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(np.bincount(back, weights=score).astype(np.float64))], ["row", "k", "base", "score"])

    return run


def _weighed(held):
    """(row, own, before) to (row, more): the change of the weights of the classes that the words are shares of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            x = held.value[b.column(1).flatten().to_numpy() % TAILS, b.column(2).flatten().to_numpy()]
            # without any word, bincount gives whole numbers
            more = np.bincount(np.repeat(np.arange(len(n)), n), weights=x, minlength=len(n)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(more)], ["row", "more"])

    return run


def _scored(held):
    """(row, text) to (row, n_tokens, n_known, base, score, key, own, before, after): sums over what the broadcast
    tables decide; the words of the tail classes go on to where their vectors are. own: the tail class, and RARE or
    HOT times TAILS more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, common, table, shares, base_total, hot = held.value
        for b in batches:
            out = [[] for _ in range(8)]
            n = []
            for _, part in blocks(b.column(1).to_pylist()):
                w = Words(part, SOLID)
                cls = _classes(w, heads)
                keys = _keys(w)
                place = common.place(keys)
                count = np.where(place >= 0, common.values[place], -1) if len(common.values) else place
                full, ends = _with_ends(w, cls, 0)
                before = np.concatenate([[0], full[:-1]])
                before[ends[:-1] + 1] = 0
                n_end = int(common.find(np.array([END]), 0)[0])
                known, _ = _with_ends(w, count, n_end)
                got = np.maximum(known, 0) + 1.0
                inner = np.where(full > HEAD, np.where(known >= 0, np.log10(got), 0.0) - shares[full], 0.0)
                base = np.where(known >= 0, np.log10(got), 0.0) - base_total
                starts = np.concatenate([[0], ends[:-1] + 1])
                out[0].append(ends - starts + 1)
                out[1].append(np.add.reduceat((known > 0).astype(np.int64), starts))
                out[2].append(np.add.reduceat(base, starts))
                out[3].append(np.add.reduceat(table[before, full] + inner, starts))
                at = np.flatnonzero(full > HEAD)
                # a common word goes on by its place, which is a smaller number than its hash
                out[4].append(_with_ends(w, np.where(place >= 0, place, keys), END)[0][at])
                out[5].append((full[at] - 1 - HEAD + TAILS * np.where(known[at] < 0, RARE, np.where(known[at] > hot, HOT, 0))).astype(np.int16))
                out[6].append(before[at].astype(np.int16))
                out[7].append(full[at + 1].astype(np.int16))
                n.append(np.diff(np.searchsorted(at, np.append(starts, len(full)))))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int32))
            cols = [pa.array(np.concatenate(x)) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols[:4], *(pa.ListArray.from_arrays(offsets, x) for x in cols[4:])], ["row", "n_tokens", "n_known", "base_score", "score", "key", "own", "before", "after"])

    return run


def score(docs: DataFrame, held_out, common_words: int = 1 << 20, doc: str = "doc_id", text: str = "text", steps: int = 300, hot: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    held_out: a condition; the other rows are learnt from, all of them, whole. Tokens are words between ASCII white
    space (A-Z lower-cased) and one end. base_score sums log10((c + 1) / (N + V + 1)). score is the model's: the class
    given the word before, and for words that are no class of their own their weight among those of their class, given
    the class before. A weight is c + 1, times what the word's own vector makes of the class before; one unseen word
    counts as 1 in each class. Both factors add to one.

    Words are keyed by 64-bit hashes. The common_words most frequent are broadcast (a fixed bound, about 16 bytes
    each); the words of the tail classes meet their counts and vectors in a shuffle, so vocabularies of any size are
    exact. Their context vectors, output vectors and biases are learnt there from all their training occurrences, which
    meet in one task for a word of at most `hot` of them. Words with more (which are broadcast, but for those rarer than all
    that are) send counts of the classes beside them instead, at most 2 K from a run of occurrences, and their vectors
    meet the occurrences in a join that may be split; so no task holds more for them. Null or
    empty text: the end alone. Null doc_id is scored; repeated rows each. Very long texts are read whole, in runs of about
    1 MB or the text itself. Other columns play no part, whatever their names. No training rows: every count is 0 and the
    model is uniform over classes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    learnt = rows.where("NOT held_out").select("text")
    counts = learnt.mapInArrow(_counted, "key long, tail int, n long").groupBy("key").agg(F.sum("n").alias("n"), F.first("tail").alias("tail"))
    counts = stash(counts, "counts")
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = int(total[0] or 0), int(total[1])
    top = counts.where(F.col("key") != int(END)).orderBy(F.desc("n"), "key").limit(HEAD).collect()
    # the most frequent words by a bound on their count, so that nothing is sorted as a whole
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n"))
    least, seen = 1, 0
    for r in by_count.toLocalIterator():
        seen += r.m
        if seen > common_words:
            least = r.n + 1
            break
    is_head = F.col("key").isin([r.key for r in top] + [int(END)])
    best = counts.where((F.col("n") >= least) | is_head).select("key", "n").toArrow()
    common = Table(best.column("key").to_numpy().astype(np.int64), best.column("n").to_numpy().astype(np.int64))
    heads = Table(np.array([r.key for r in top], dtype=np.int64), np.arange(1, len(top) + 1))
    held_heads = spark.sparkContext.broadcast(heads)
    tails = counts.where(~is_head).groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_n, class_v = np.zeros(K), np.zeros(K)
    class_n[0] = max(0, int(common.find(np.array([END]), 0)[0]))
    for i, r in enumerate(top):
        class_n[1 + i] = r.n
    for r in tails:
        class_n[1 + HEAD + r.tail], class_v[1 + HEAD + r.tail] = r.n, r.v
    pairs = learnt.mapInArrow(_pairs(held_heads), "before int, after int, n long").groupBy("before", "after").agg(F.sum("n").alias("n")).orderBy("before", "after").toArrow()
    pairs = np.stack([pairs.column(c).to_numpy() for c in ("before", "after", "n")], 1).astype(np.int64)
    h, r, bias = train_vectors(pairs, class_n, steps=steps)
    table = _table(h, r, bias)
    shares = np.log10(class_n + class_v + 1)
    held = spark.sparkContext.broadcast((heads, common, table, shares, np.log10(n + v + 1), hot))
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    part = keyed.select(F.struct("row", "doc_id", "held_out").alias("row"), "text")
    kind = docs.schema[doc].dataType.simpleString()
    lists = "key array<bigint>, own array<smallint>, before array<smallint>, after array<smallint>"
    part = part.mapInArrow(_scored(held), f"row struct<row: bigint, doc_id: {kind}, held_out: boolean>, n_tokens long, n_known long, base_score double, score double, {lists}")
    part = stash(part.select("row.*", "n_tokens", "n_known", "base_score", "score", "key", "own", "before", "after"), "scored")
    around = np.zeros((TAILS, K), dtype=np.float32)
    tail = pairs[pairs[:, 1] > HEAD]
    around[tail[:, 1] - 1 - HEAD, tail[:, 0]] = tail[:, 2]
    own = spark.sparkContext.broadcast((table * np.float32(np.log(10)), h.astype(np.float32), r.astype(np.float32), around))
    # the words of a tail class in few tasks, so that the weights they add stay few: about 4,000 words each
    split = F.pmod("key", F.lit(1 + v // (4_000 * TAILS)))
    places = part.select("row", "held_out", "key", "own", "before", "after")
    # as many tasks as occurrences are worth, where that is more than the session's partitions
    tasks = n // 4_000_000
    dealt = [tasks, "own", split] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else ["own", split]
    fitted = places.mapInArrow(_occurrences(False), "own int, key long, places binary").repartition(*dealt).sortWithinPartitions("own", "key")
    fitted = stash(fitted.mapInArrow(_fitted(own), "row long, k long, base double, score double"), "fitted")
    weights = fitted.where("row < 0").select("row", F.col("score").alias("w"))
    if ((common.values > hot) & (heads.find(common.keys, -1) < 0) & (common.keys != END)).any():
        seen = part.where("NOT held_out").select("key", "own", "before", "after").mapInArrow(_hot_counts, "own int, key long, counts binary")
        seen = seen.repartition("own", split).sortWithinPartitions("own", "key")
        words = stash(seen.mapInArrow(_hot_vectors(own), "key long, row long, vec binary, w double"), "words")
        weights = weights.unionByName(words.where("row < 0").select("row", "w"))
        vectors = spark.sparkContext.broadcast((_biased(h.astype(np.float32)), r.astype(np.float32)))
        met = places.mapInArrow(_occurrences(True), "own int, key long, places binary").join(words.where("row >= 0").select("key", "vec"), "key").select("places", "vec")
        fitted = fitted.unionByName(met.mapInArrow(_hot_scores(vectors), "row long, k long, base double, score double"))
    weight = weights.groupBy("row").agg(F.sum("w").alias("w")).toArrow()
    added = np.zeros(TAILS * K)
    added[-1 - weight.column("row").to_numpy()] = weight.column("w").to_numpy()
    whole = (class_n + class_v + 1)[1 + HEAD :, None]
    change = spark.sparkContext.broadcast(-np.log10(np.maximum(whole + added.reshape(TAILS, K), 1) / whole))
    weighed = part.select("row", "own", "before").mapInArrow(_weighed(change), "row long, more double")
    zero = F.lit(0.0)
    more = fitted.where("row >= 0").unionByName(weighed.select("row", F.lit(0).cast("long").alias("k"), zero.alias("base"), F.col("more").alias("score")))
    more = more.groupBy("row").agg(F.sum("k").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    out = part.drop("key", "own", "before", "after").join(more, "row")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("k")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("b")).alias("base_score"), (F.col("score") + F.col("s")).alias("score"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score(docs, fold % 7 == 2)
