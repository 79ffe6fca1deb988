"""LM scoring by a gated recurrent language model.

Word counts over all training documents give the base model, the model's
vocabulary and its word classes.  The recurrent part is trained in numpy by
truncated backpropagation through every window of every training document,
the state carried from window to window of a document.  The softmax is
factored into classes: classes of vocabulary words of like frequency, and one
whose members are the classes of all other words, by the hash of their last
bytes, where a word has its add-one share of its class's count.  A document is
scored with the state carried across windows from its first token to its end.

Training is independent of how the table is partitioned.  Texts are split into
words once, some at a time, and a word is looked up once for all of these; training documents are dealt to blocks of about ``block_tokens`` tokens
by a hash of their id and codes, as many blocks as the number of training
tokens asks for.  Each of ``rounds`` rounds over all of them goes part by part:
every block of a part runs its documents in parallel streams from the weights so
far, with a gradient step on every ``every``-th window, by default on all, and the
blocks' weights are averaged by their tokens.

Scale.  Counts are summed in each batch before their shuffle.  The vocabulary
and the table of frequent counts that tasks hold have fixed bounds; the other
words of a document get their counts by a join.  Blocks have a bounded size
and are rows of a written table.  Weights (about 1 MB) are averaged by pieces,
never gathered block by block on the driver.

Rows.  A null or empty text is its end token.  A null id is never held out.
Without training documents counts are 0 and the model is its start.  Repeated
rows come back once each.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import arrow_map, forget, frequent, held_out, slices, words, written

#: The end of a text as a word; no word holds a line end.
END = b"\n"
CLASS = 64  # words in a class of the vocabulary
TAILS = CLASS  # classes of other words, the members of the last class
HIDDEN = 16
ROWS = 4096  # tokens whose shares are computed together


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def split(docs: DataFrame, chunk_tokens: int = 1 << 20) -> DataFrame:
    """``(doc_ids, lengths, codes, words, counts)``: some rows' texts at a time, of about ``chunk_tokens`` tokens, split into words once.

    ``codes`` are places among the chunk's own words, 0 the end of a text and 1 the first of ``words``; ``counts`` are
    those in training documents.
    """
    import pyarrow as pa

    names = ["doc_ids", "lengths", "codes", "words", "counts"]
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def row(doc_ids, train, held, own):
        lengths, codes = np.array([len(c) for c in held], dtype=np.int32), np.concatenate(held)
        counts = np.bincount(codes[np.repeat(np.array(train, dtype=bool), lengths)], minlength=len(own))
        found = b"\n".join(list(own)[1:])
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((doc_ids, lengths.tobytes(), codes.tobytes(), found, counts.tobytes()), kinds)], names=names)

    def run(batches):
        doc_ids, train, held, size, own = [], [], [], 0, None
        for b in slices(batches):
            for doc_id, learned, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "train", "text"))):
                if own is None:
                    own = defaultdict(itertools.count().__next__)
                    own[END]  # the end comes first
                found = words(t)
                found.append(END)
                held.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
                doc_ids.append(doc_id)
                train.append(learned)
                size += len(found)
                if size >= chunk_tokens:
                    yield row(doc_ids, train, held, own)
                    doc_ids, train, held, size, own = [], [], [], 0, None
        if held:
            yield row(doc_ids, train, held, own)

    return docs.select("doc_id", (~held_out(7)).alias("train"), "text").mapInArrow(run, "doc_ids array<bigint>, lengths binary, codes binary, words binary, counts binary")


def chunk_words(found: bytes) -> list[bytes]:
    """The words of a chunk of ``split`` by code."""
    return [END, *found.split(b"\n")] if found else [END]


def word_counts(chunks: DataFrame) -> DataFrame:
    """``(word, n)`` over the training texts of ``split``, one end each."""

    def count(found, counts):
        found, counts = [w for x in found for w in chunk_words(x)], np.concatenate([np.frombuffer(c, dtype=np.int64) for c in counts])
        return {"word": found, "n": counts}

    return arrow_map(chunks, "word binary, n bigint", count, "words", "counts", rows=1).where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


class Net:
    """The network's weights in one flat array, and its forward and backward passes.

    All biases are the last rows of their matrices, and states have a last
    column of ones for them.  In the recurrence each step's states and gates
    lie together, a row a unit; the softmax has a row a token.
    """

    def __init__(self, class_bias: np.ndarray, word_bias: np.ndarray, flat: np.ndarray | None = None):
        """``class_bias``: of the classes of ``word_bias``, then of the classes of other words, which become members of one more class."""
        tails = class_bias[len(word_bias) :]
        together = np.log(np.exp(tails).sum())
        class_bias, word_bias = np.r_[class_bias[: len(word_bias)], together], np.vstack([word_bias, tails - together])
        h, c = HIDDEN, len(class_bias)
        self.shapes = {"inputs": (c * CLASS, 3 * h), "recur": (h, 3 * h), "to_class": (h + 1, c), "to_word": (c, h + 1, CLASS)}
        size = sum(map(math.prod, self.shapes.values()))
        self.flat = np.zeros(size, dtype=np.float32) if flat is None else flat.astype(np.float32)
        self.parts = self.view(self.flat)
        self.rooms: dict[str, np.ndarray] = {}
        if flat is None:
            rng = np.random.default_rng(5)
            self.parts["inputs"][:] = rng.normal(0, 0.3, self.shapes["inputs"])
            self.parts["recur"][:] = rng.normal(0, 0.2, self.shapes["recur"])
            self.parts["to_class"][h] = class_bias
            self.parts["to_word"][:, h] = word_bias

    def view(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array with any content that the next call by this name takes over, so that windows need no new memory."""
        size = math.prod(shape)
        if len(self.rooms.get(name, ())) < size:
            self.rooms[name] = np.empty(size, dtype=np.float32)
        return self.rooms[name][:size].reshape(shape)

    def forward(self, x: np.ndarray, edges: np.ndarray, fresh: dict[int, np.ndarray], h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """The states after each input, with a column of ones, and what ``backward`` needs if ``keep``.

        Step t's inputs are ``x[edges[t]:edges[t + 1]]``, for the first rows of
        ``h``, whose live rows are left at the last states; rows ``fresh[t]`` begin anew.
        Results hold until the next call.
        """
        k, size = HIDDEN, len(x)
        recur = self.parts["recur"].T.copy()
        recur[: 2 * k] *= -1  # exp takes the gates' negated sums
        inputs = np.take(self.parts["inputs"], x, axis=0, out=self.room("inputs", size, 3 * k), mode="clip")
        states = self.room("states", size, k + 1)
        states[:, k] = 1
        # of each step, one after another
        past, gate = self.room("past", 3 * k * size), self.room("gate", 2 * k * len(h))
        z, r, n, less, new = (self.room(name, k * size) for name in ("z", "r", "n", "less", "new"))
        own, before = h[: edges[1] - edges[0]].T.copy(), []
        for t, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            shape, at = (k, j - i), slice(k * i, k * j)
            if own.shape[1] > j - i:
                own = own[:, : j - i].copy()
            if t in fresh:
                own = own.copy()
                own[:, fresh[t]] = 0
            before.append(own)
            u, a, gates = past[3 * k * i : 3 * k * j].reshape(3 * k, j - i), inputs[i:j].T, gate[: 2 * k * (j - i)].reshape(2 * k, j - i)
            zt, rt, nt, lt = z[at].reshape(shape), r[at].reshape(shape), n[at].reshape(shape), less[at].reshape(shape)
            np.matmul(recur, own, out=u)
            gates[:] = a[: 2 * k]
            np.subtract(u[: 2 * k], gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates[:k], out=zt)
            np.reciprocal(gates[k:], out=rt)
            np.multiply(u[2 * k :], rt, out=nt)
            nt += a[2 * k :]
            np.tanh(nt, out=nt)
            np.subtract(own, nt, out=lt)
            own = np.multiply(lt, zt, out=new[at].reshape(shape))
            own += nt
            states[i:j, :k] = own.T
        h[: own.shape[1]] = own.T
        return states, (before, past, z, r, n, less)

    def backward(self, x: np.ndarray, edges: np.ndarray, fresh: dict[int, np.ndarray], kept: tuple, dh: np.ndarray, grad: dict) -> None:
        """Truncated backpropagation through one window; ``dh``: the gradient by its states."""
        k, size, carry, recur = HIDDEN, len(x), None, self.parts["recur"]
        before, past, z, r, n, less = kept
        by_state, inner = self.room("by state", 3 * k, size), self.room("inner", k, size)
        step = self.room("step", 3 * k * int(np.diff(edges).max()))
        for t in range(len(edges) - 2, -1, -1):
            i, j = int(edges[t]), int(edges[t + 1])
            shape, at = (k, j - i), slice(k * i, k * j)
            zt, rt, dn, s = z[at].reshape(shape), r[at].reshape(shape), n[at].reshape(shape), step[: 3 * k * (j - i)].reshape(3 * k, j - i)
            d, dz, dr, rest = dh[i:j].T.copy(), s[:k], s[k : 2 * k], s[2 * k :]
            if carry is not None:
                if carry.shape == d.shape:
                    d += carry
                else:
                    d[:, : carry.shape[1]] += carry
            np.multiply(d, zt, out=rest)  # what passes on to the state before
            np.multiply(less[at].reshape(shape), rest, out=dz)
            passed = rest.copy() if t else None
            np.subtract(d, rest, out=rest)  # and to the new part
            np.subtract(1, zt, out=zt)
            dz *= zt
            dn *= dn
            np.subtract(1, dn, out=dn)
            dn *= rest
            np.multiply(dn, rt, out=rest)
            np.subtract(1, rt, out=rt)
            np.multiply(rest, rt, out=dr)
            dr *= past[3 * k * i : 3 * k * j].reshape(3 * k, j - i)[2 * k :]
            by_state[:, i:j], inner[:, i:j] = s, dn
            if t:
                carry = recur @ s
                carry += passed
                if t in fresh:
                    carry[:, fresh[t]] = 0
        grad["recur"] += np.concatenate(before, axis=1) @ by_state.T
        by_state[2 * k :] = inner
        x = x.astype(np.intp)
        words = self.room("words", 3 * k, len(self.parts["inputs"]))
        for of, own in zip(words, by_state):
            of[:] = np.bincount(x, own, len(of))
        grad["inputs"] += words.T

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each target's class and in-class share, and the gradient by ``h`` where one is asked for."""
        size, kind, classes = len(y), y // CLASS, len(self.parts["to_word"])
        # rows by class, so that a class's are a slice
        order = np.argsort(kind.astype(np.uint8) if classes < 256 else kind, kind="stable")
        own, word, kind = np.take(h, order, axis=0, out=self.room("own", *h.shape), mode="clip"), y[order] % CLASS, kind[order]
        edges = np.searchsorted(kind, np.arange(classes + 1)).tolist()
        shares = np.empty((2, size), dtype=np.float32)
        dh = None if grad is None else self.room("dh", 2, size, HIDDEN)
        for a in range(0, size, ROWS):
            self._softmax(own[a : a + ROWS], kind[a : a + ROWS], [(None, 0, min(ROWS, size - a))], "to_class", shares[0, a : a + ROWS], grad, None if grad is None else dh[0, a : a + ROWS])
        first = 0
        while first < classes:  # classes of together about that many rows
            last = first + 1
            while last < classes and edges[last + 1] - edges[first] <= ROWS:
                last += 1
            a, b = edges[first], edges[last]
            if a < b:
                found = [(k, edges[k] - a, edges[k + 1] - a) for k in range(first, last) if edges[k] < edges[k + 1]]
                self._softmax(own[a:b], word[a:b], found, "to_word", shares[1, a:b], grad, None if grad is None else dh[1, a:b])
            first = last
        np.log(shares, out=shares)
        out = np.empty(size, dtype=np.float64)
        out[order] = shares.sum(axis=0, dtype=np.float64)
        if grad is None:
            return out, None
        dh[0] += dh[1]
        dh[1, order] = dh[0]
        return out, dh[1]

    def _softmax(self, h: np.ndarray, y: np.ndarray, groups: list[tuple[int | None, int, int]], name: str, share: np.ndarray, grad: dict | None, dh: np.ndarray | None) -> None:
        """Each target's share; adds to the weights' gradient and sets that by ``h``.

        Rows i to j of each (k, i, j) of ``groups`` have the weights ``parts[name][k]``, or all of them.
        """
        weights = self.parts[name]
        e = self.room("e", len(y), weights.shape[-1])
        for k, i, j in groups:
            np.matmul(h[i:j], weights if k is None else weights[k], out=e[i:j])
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], dtype=np.float32)
        at = np.arange(0, e.size, e.shape[1]) + y
        hit = e.reshape(-1)[at]
        np.divide(hit, total, out=share)
        if grad is not None:
            e.reshape(-1)[at] = hit - total
            total = total[:, None]
            h, by_weight = h / total, grad[name]
            for k, i, j in groups:
                own, of = (weights, by_weight) if k is None else (weights[k], by_weight[k])
                of += (e[i:j].T @ h[i:j]).T
                np.matmul(e[i:j], own[:HIDDEN].T, out=dh[i:j])
            dh /= total


class Streams:
    """Documents one after another in up to ``most`` parallel streams, longest first into the shortest stream.

    Streams are in order of length, so that the live ones at a step come first.
    A document's first input is the end token.  With a ``seed`` a stream's
    documents are shuffled.
    """

    def __init__(self, codes: list[np.ndarray], end: int, most: int, seed: int | None = None):
        heap = [(0, k) for k in range(min(most, len(codes)))]
        self.streams: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(codes)), key=lambda i: -len(codes[i])):
            size, k = heap[0]
            heapq.heapreplace(heap, (size + len(codes[i]), k))
            self.streams[k].append(i)
        if seed is not None:
            rng = np.random.default_rng(seed)
            self.streams = [rng.permutation(own).tolist() for own in self.streams]
        sizes = dict((k, size) for size, k in heap)
        self.streams.sort(key=lambda s: -sum(len(codes[i]) for i in s))
        lengths = np.array(sorted(sizes.values(), reverse=True))
        self.live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.edges = np.r_[0, np.cumsum(self.live)]
        self.y = np.empty(self.edges[-1], dtype=np.int32)
        self.x = np.empty(self.edges[-1], dtype=np.int32)
        begun: dict[int, list[int]] = {}
        for d, own in enumerate(self.streams):
            whole = np.concatenate([codes[i] for i in own])
            at = self.edges[: len(whole)] + d
            self.y[at] = whole
            self.x[at[1:]] = whole[:-1]
            t = 0
            for i in own:
                begun.setdefault(t, []).append(d)
                self.x[at[t]] = end
                t += len(codes[i])
        self.begun = {t: np.array(d) for t, d in begun.items()}

    def windows(self, steps: int | None = None, most_tokens: int | None = None):
        """(inputs, targets, edges within, rows that begin anew by step) of ``steps`` steps, or as many as ``most_tokens`` allow, one at least."""
        a, last = 0, len(self.live)
        while a < last:
            b = a + steps if steps else max(a + 1, int(np.searchsorted(self.edges, self.edges[a] + most_tokens, side="right")) - 1)
            b = min(b, last)
            i, j = self.edges[a], self.edges[b]
            yield a, b, self.x[i:j], self.y[i:j], self.edges[a : b + 1] - i, {t - a: self.begun[t] for t in range(a, b) if t in self.begun}
            a = b


def log_likelihoods(net: Net, codes: list[np.ndarray], end: int, most: int = 512, window_tokens: int = 32_768) -> np.ndarray:
    """Natural log probability of each document's classes and words, the state carried from window to window."""
    docs = Streams(codes, end, most)
    h, flat = np.zeros((len(docs.streams), HIDDEN), dtype=np.float32), np.empty(len(docs.y))
    for a, b, x, y, edges, fresh in docs.windows(most_tokens=window_tokens):
        states, _ = net.forward(x, edges, fresh, h)
        flat[docs.edges[a] : docs.edges[b]] = net.outputs(states, y)[0]
    out = np.empty(len(codes))
    for d, own in enumerate(docs.streams):
        t = 0
        for i in own:
            out[i] = flat[docs.edges[t : t + len(codes[i])] + d].sum()
            t += len(codes[i])
    return out


class Trainer:
    """Adam over windows; keeps how many tokens it has learned from."""

    def __init__(self, net: Net, rate: float, window: int, every: int = 1):
        self.net, self.rate, self.window, self.every = net, rate, window, every
        self.m, self.v, self.grad = (np.zeros_like(net.flat) for _ in range(3))
        self.windows = self.steps = self.tokens = 0

    def documents(self, codes: list[np.ndarray], end: int, most: int = 256, longest: int = 8192) -> None:
        """Learns from every ``every``-th window of all.  Documents of over ``longest`` tokens are run as several, so that streams are of like length."""
        codes = [own[a : a + longest] for own in codes for a in range(0, len(own), longest)]
        most = min(most, max(1, sum(map(len, codes)) // max(map(len, codes))))
        docs, net, parts = Streams(codes, end, most, seed=0), self.net, self.net.view(self.grad)
        h = np.zeros((len(docs.streams), HIDDEN), dtype=np.float32)
        for _, _, x, y, edges, fresh in docs.windows(self.window):
            learn = self.windows % self.every == 0  # one count over all documents
            self.windows += 1
            states, kept = net.forward(x, edges, fresh, h, keep=learn)
            if learn:
                self.grad[:] = 0
                _, dh = net.outputs(states, y, parts)
                net.backward(x, edges, fresh, kept, dh, parts)
                self.grad *= 1 / len(y)
                self.learn(self.grad, len(y))

    def learn(self, grad: np.ndarray, tokens: int) -> None:
        """A step by ``grad``, its length one at most; overwrites it."""
        self.steps += 1
        self.tokens += tokens
        size, k = math.sqrt(float(grad @ grad)), self.steps
        # m and v are kept without their factors of 0.1 and 0.01
        root = math.sqrt(0.01 / (1 - 0.99**k))
        rate, least = self.rate * 0.1 / (1 - 0.9**k) / root, 1e-8 / root
        for a in range(0, len(grad), 1 << 14):  # pieces that stay in cache
            g, m, v, flat = (x[a : a + (1 << 14)] for x in (grad, self.m, self.v, self.net.flat))
            if size > 1:
                g *= 1 / size
            m *= 0.9
            m += g
            g *= g
            v *= 0.99
            v += g
            np.sqrt(v, out=g)
            g += least
            np.divide(m, g, out=g)
            g *= rate
            flat -= g


class Codes(dict):
    """Rows by word; words it lacks have the row of their class."""

    unknown = 0

    def __missing__(self, word: bytes) -> int:
        return self.unknown + tail_class(word)


class Tables:
    """What tasks know of the training counts: the vocabulary, the frequent words, the classes' sums."""

    def __init__(self, vocabulary: list[tuple[bytes, int]], frequent_: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]], n: int, v: int):
        self.n, self.v = n, v
        self.classes = max(1, -(-len(vocabulary) // CLASS))
        size = self.classes * CLASS
        counts = np.zeros(size)
        counts[: len(vocabulary)] = [c for _, c in vocabulary]
        real = np.arange(size) < len(vocabulary)
        by_class = (counts + real).reshape(-1, CLASS)
        self.tail_sizes = np.array([sum(tails.get(k, (0, 0))) + 1 for k in range(TAILS)], dtype=float)
        mass = np.r_[by_class.sum(axis=1), self.tail_sizes]
        self.class_bias = np.log(mass / mass.sum())
        with np.errstate(divide="ignore"):
            shares = np.log(by_class / by_class.sum(axis=1, keepdims=True))
        self.word_bias = np.where(np.isfinite(shares), shares, -60.0)
        self.code = Codes((w, i) for i, (w, _) in enumerate(vocabulary))
        self.end = self.code[END]
        base, tail, target = [math.log10((c + 1) / (n + v + 1)) for _, c in vocabulary], [0.0] * len(vocabulary), list(range(len(vocabulary)))
        for w, c in frequent_:
            if w not in self.code:
                self.code[w] = len(base)
                k = tail_class(w)
                base.append(math.log10((c + 1) / (n + v + 1)))
                tail.append(math.log10((c + 1) / self.tail_sizes[k]))
                target.append(size + k)
        self.seen = np.array([c > 0 for _, c in vocabulary] + [True] * (len(base) - len(vocabulary)) + [False] * TAILS)
        # the last rows stand for the classes of words that tasks know nothing of
        self.unknown = self.code.unknown = len(base)
        self.base = np.array(base + [0.0] * TAILS)
        self.tail = np.array(tail + [0.0] * TAILS)
        self.target = np.array(target + [size + k for k in range(TAILS)], dtype=np.uint16)


def tables(counts: DataFrame, vocabulary: int = 4096, table: int = 131_072) -> Tables:
    of = lambda df: sorted(((bytes(r["word"]), r["n"]) for r in df.collect()), key=lambda x: (-x[1], x[0]))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    known = of(frequent(counts.where(F.col("word") != F.lit(END)), vocabulary - 1))
    ends = counts.where(F.col("word") == F.lit(END)).collect()
    known = sorted([*known, (END, ends[0]["n"] if ends else 0)], key=lambda x: (-x[1], x[0]))
    least = min((c for w, c in known if w != END), default=None)
    rest = counts.where(F.col("word") != F.lit(END)).where(F.lit(True) if least is None else F.col("n") < least)
    # the vocabulary takes whole count classes, so what is left lies below its least count
    in_tail = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(TAILS)).cast("int")
    tails = {r["k"]: (r["n"], r["v"]) for r in rest.groupBy(in_tail.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    return Tables(known, of(frequent(rest, table - vocabulary)), tails, sums["n"], sums["v"])


def encoded(chunks: DataFrame, shared) -> DataFrame:
    """``(key, doc_id, n_tokens, n_known, base, model, tail, codes)`` of each row of ``split``; ``shared``: broadcast Tables.

    ``tail`` counts the words that tasks know nothing of; ``n_known``, ``base``
    and ``model``, the shares in their classes of words outside the vocabulary, lack them.
    """
    import pyarrow as pa

    names = ["key", "doc_id", "n_tokens", "n_known", "base", "model", "tail", "codes"]

    def run(batches):
        from pyspark import TaskContext

        known: Tables = shared.value
        key = TaskContext.get().partitionId() << 40
        for b in slices(batches, 1):  # a word of a chunk is looked up once
            doc_ids = b.column("doc_ids").flatten()
            lengths, local = (np.frombuffer(b.column(c)[0].as_py(), dtype=np.int32) for c in ("lengths", "codes"))
            found, n = chunk_words(b.column("words")[0].as_py()), len(lengths)
            own = np.fromiter(map(known.code.__getitem__, found), np.int32, len(found))[local]
            edges = np.r_[0, np.cumsum(lengths)]
            sums = lambda x: np.add.reduceat(x[own], edges[:-1], dtype=np.int64 if x.dtype == bool else x.dtype)  # noqa: B023, E731
            rare = np.flatnonzero(own >= known.unknown)
            pairs, tf = np.unique(np.repeat(np.arange(n), lengths)[rare] * len(found) + local[rare], return_counts=True)
            counted = pa.StructArray.from_arrays([pa.array(found, pa.binary()).take(pa.array(pairs % len(found))), pa.array(tf.astype(np.int32))], names=["word", "tf"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(found)).astype(np.int32)), counted)
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(known.target[own])])
            columns = [np.arange(key, key + n), doc_ids, lengths.astype(np.int64), sums(known.seen), sums(known.base), sums(known.tail)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), tail, codes], names=names)
            key += n

    kind = "key bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, model double, tail array<struct<word:binary,tf:int>>, codes binary"
    return chunks.select("doc_ids", "lengths", "codes", "words").mapInArrow(run, kind)


def blocks(coded: DataFrame, parts: int = 2, block_tokens: int = 1 << 21) -> DataFrame:
    """``(block, part, lengths, codes)``: the training documents of ``coded``, dealt and ordered by hash, some in each part.

    A block holds about ``block_tokens`` tokens; one that hot hashes make larger is cut into several rows.
    """
    import pyarrow as pa

    n = coded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    count = parts * max(1, round(n / (parts * block_tokens)))
    names = ["block", "part", "lengths", "codes"]

    def row(block, held):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([block % parts], pa.int32()), pa.array([np.array([len(c) // 2 for c in held], dtype=np.int32).tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary())], names=names)

    def run(batches):
        block, held, size = None, [], 0
        for b in slices(batches):
            for k, codes in zip(b.column("block").to_pylist(), b.column("codes").to_pylist()):
                if held and (k != block or size > 3 * block_tokens):  # in bytes, two a token
                    yield row(block, held)
                    held, size = [], 0
                block = k
                held.append(codes)
                size += len(codes)
        if held:
            yield row(block, held)

    by_hash = coded.select(F.xxhash64("doc_id", "codes").alias("at"), "codes").withColumn("block", F.pmod(F.col("at"), F.lit(count)))
    dealt = by_hash.repartitionById(count, F.col("block").cast("int")).sortWithinPartitions("block", "at", "codes")
    return written(dealt.select("block", "codes").mapInArrow(run, "block bigint, part int, lengths binary, codes binary"), "lm-blocks")


def train(dealt: DataFrame, shared, rounds: int = 2, parts: int = 2, rate: float = 0.02, window: int = 32, every: int = 1, streams: int = 256, pieces: int = 16) -> np.ndarray:
    """The flat weights after ``rounds`` rounds over the rows of ``blocks``, averaged after each part; ``shared``: broadcast Tables.

    The rate falls evenly from part to part.
    """
    import pyarrow as pa

    spark = dealt.sparkSession
    known: Tables = shared.value
    weights = Net(known.class_bias, known.word_bias).flat
    names, kind = ["block", "piece", "tokens", "data"], "block bigint, piece int, tokens bigint, data binary"

    def average(batches):
        sums: dict[int, tuple[float, np.ndarray]] = {}
        for b in batches:  # in order of blocks, so that sums don't depend on tasks
            for piece, tokens, data in zip(*(b.column(c).to_pylist() for c in names[1:])):
                at, total = sums.get(piece, (0.0, 0.0))
                sums[piece] = at + tokens, total + tokens * np.frombuffer(data, dtype=np.float32).astype(np.float64)
        out = sorted(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(out), pa.int64()), pa.array([k for k, _ in out], pa.int32()), pa.array([int(n) for _, (n, _) in out], pa.int64()), pa.array([(t / n).astype(np.float32).tobytes() for _, (n, t) in out], pa.binary())], names=names)

    for r in range(rounds * parts):
        start = spark.sparkContext.broadcast(weights)

        def learn(batches, start=start, rate=rate * (1 - r / (rounds * parts))):
            known: Tables = shared.value
            for b in batches:
                for block, lengths, codes in zip(*(b.column(c) for c in ("block", "lengths", "codes"))):
                    trainer = Trainer(Net(known.class_bias, known.word_bias, start.value), rate, window, every)
                    edges = np.cumsum(np.frombuffer(lengths.as_py(), dtype=np.int32))
                    trainer.documents(np.split(np.frombuffer(codes.as_py(), dtype=np.uint16), edges[:-1]), known.end, streams)
                    data = [p.tobytes() for p in np.array_split(trainer.net.flat, pieces)]
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * pieces), pa.array(range(pieces), pa.int32()), pa.array([trainer.tokens] * pieces, pa.int64()), pa.array(data, pa.binary())], names=names)

        learned = dealt.where(F.col("part") == r % parts).select("block", "lengths", "codes").mapInArrow(learn, kind)
        found = learned.repartition(pieces, "piece").sortWithinPartitions("piece", "block", "tokens", "data").mapInArrow(average, kind).collect()  # ``pieces`` rows
        if found:
            weights = np.concatenate([np.frombuffer(bytes(x["data"]), dtype=np.float32) for x in sorted(found, key=lambda x: x["piece"])])
        start.unpersist()
    return weights


def score(docs: DataFrame, vocabulary: int = 4096, table: int = 131_072, parts: int = 2, block_tokens: int = 1 << 21, **training) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of each row."""
    import pyarrow as pa

    spark = docs.sparkSession
    chunks = written(split(docs), "lm-words")
    counts = written(word_counts(chunks), "lm-counts")
    known = tables(counts, vocabulary, table)
    shared = spark.sparkContext.broadcast(known)
    coded = written(encoded(chunks, shared), "lm-codes")
    forget(chunks)
    weights = spark.sparkContext.broadcast(train(blocks(coded.where(~held_out(7)), parts, block_tokens), shared, parts=parts, **training))
    names = ["key", "doc_id", "n_tokens", "n_known", "base", "model"]

    def run(batches):
        known: Tables = shared.value
        net = Net(known.class_bias, known.word_bias, weights.value)
        for b in batches:
            codes, model, a = b.column("codes"), np.empty(b.num_rows), 0
            sizes = np.cumsum(b.column("n_tokens").to_numpy())
            while a < b.num_rows:
                e = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + (1 << 21), side="right")))
                model[a:e] = log_likelihoods(net, [np.frombuffer(c, dtype=np.uint16) for c in codes.slice(a, e - a).to_pylist()], known.end)
                a = e
            model = b.column("model").to_numpy() + model / math.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(model)], names=names)

    scored = coded.select(*names, "codes").mapInArrow(run, "key bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, model double")
    rare = coded.select("key", F.explode("tail").alias("x")).select("key", "x.word", "x.tf")
    sizes = F.array(*map(F.lit, known.tail_sizes.tolist()))
    seen = F.coalesce(F.col("n"), F.lit(0))
    tail_size = F.element_at(sizes, F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(TAILS)).cast("int") + 1)
    sums = rare.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.when(seen > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10((seen + 1) / F.lit(float(known.n + known.v + 1)))).alias("more_base"),
        F.sum(F.col("tf") * F.log10((seen + 1) / tail_size)).alias("more_model"),
    )
    all_ = scored.join(sums, "key", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return all_.select("doc_id", held_out(7).alias("held_out"), "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(known.n).cast("bigint").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("model", "more_model").alias("score"))
