"""Language-model scoring by logistic context mixing.

A text is a sequence of tokens: its words, A-Z folded, and one end. Each token is coded by binary decisions, and the
score is the log10 probability of them all. There are two kinds of decisions.

1. Which word of the VOCABULARY, the end, or `spelled` (another word). Its Huffman code's bits are predicted from six
   hashed contexts of the tokens before (none, the class of one, the classes of two, the word before, the last two
   frequent words however far back, the two words before). Classes are the HEAD most frequent words, the end, `mid` and
   `spelled`.
2. Which spelled word: the bits of its letters' Huffman codes, predicted from six contexts within the word and from the
   word before with the letters so far. A word that was seen can also be coded by its count, with the share of words that
   were seen more than once (Good-Turing); both probabilities add up.

Every bit predictor is a pair of counts in a slot of a hashed table, gathered from all training texts. Predictions are
mixed in the logistic domain; the weights are chosen by a gate (depth in the code, and how often two of the contexts
were seen) and learned online, bit by bit in batches, from all training texts, each bit's own contribution taken out of
the counts (leave one out). An adaptive probability map, learned alongside, refines the mix. Each task learns from its
texts; the tasks' weights are averaged by the bits that each gate saw, their maps' hits are summed. Only the weights that
all tasks begin with come from a bounded sample. Total bits per byte of the text are given too.

Sizes: the vocabulary has at most VOCABULARY words of at most WORD_BYTES bytes. The tables' slots grow with the bits that
are counted in them, so that contexts collide no more on a large corpus than on a small one. Of a context, the slots for up to
LEVELS bits of a code lie together. Tables are mapped files in the machine's temporary folder or the executor's own, so the
system's page cache holds what it has room for and no process's memory grows with them:
8 bytes a slot in each of the counting tasks, of which there are as many as cores, 2 bytes a slot and machine afterwards.
Counts of all other words stay in a table, which is joined to the texts by word.

The passes over all texts (counting, learning, scoring) are bitcode's, in the executors' JVM. Here are the same steps for arrays:
the driver learns the weights to begin with by them, and tests compare both.

Defined cases: a null or empty text has the end as its only token; with no training text at all every bit has
probability 1/2 and the base's counts are 0; a null doc_id is learned from and isn't held out; repeated rows are scored
each and learned from each; other columns aren't read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import os
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import bitcode
from chronoloom.llm.common import discard, is_remainder, materialize, words_of
from chronoloom.llm.fitting import one_text, sample_ids

FOLDS, HELD_OUT = 5, 1
#: Words with a class of their own in contexts, words in the vocabulary, bytes of a word in it, its least count. Rarer words are
#: spelled, also in training, so that spelling is learned from words like those that are yet unseen.
HEAD, VOCABULARY, WORD_BYTES, LEAST_COUNT = 253, 65_536, 64, 6
#: Size of the sample that the mixing weights begin with: ids, and one whole text of each, of any length.
SAMPLE_TEXTS = 1500
#: Tokens, and bits, that are worked on at once.
_TOKENS, _BITS = 250_000, 700_000

SPELLED, END, MID = 0, 1, 2
_SEED = 42  # that of Spark's xxhash64


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of each symbol as ranges of flat arrays: start, length, inner node before each bit, bit."""
    n = len(counts)
    heap = [(int(c) + 1, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit = {}, {}
    node = n
    while len(heap) > 1:
        (c0, a), (c1, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], bit[a], parent[b], bit[b] = node, 0, node, 1
        heapq.heappush(heap, (c0 + c1, node))
        node += 1
    start, length, nodes, bits = [], [], [], []
    for s in range(n):
        path, x = [], s
        while x in parent:
            path.append((parent[x] - n, bit[x]))
            x = parent[x]
        start.append(len(nodes))
        length.append(len(path))
        nodes += [p for p, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    return np.array(start), np.array(length), np.array(nodes, np.uint64), np.array(bits, np.int8)


#: Bits of a code that share a line of a table, which are 2^LEVELS slots: of 2 bytes each, that's 64 bytes, a line of the processor's cache.
LEVELS = 5


def lines(start: np.ndarray, length: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bit of the codes: the node of the first bit of its line, and its place there, which are 1 and the bits between."""
    at = np.arange(len(nodes))
    level = (at - np.repeat(start, length)) % LEVELS
    first, place = at - level, np.ones(len(at), np.uint64)
    for k in range(LEVELS - 1):
        on = level > k
        place[on] = 2 * place[on] + bits[first[on] + k].astype(np.uint64)
    return nodes[first], place


#: Counts as bytes: 0 to 15 as they are, then 8 a doubling.
_STEPS = 8
_COUNT_OF = np.concatenate([np.arange(16), np.rint(16 * 2 ** ((np.arange(240) + 0.5) / _STEPS))])


def _count_codes(n: np.ndarray) -> np.ndarray:
    large = 16 + np.floor(np.log2(np.maximum(n, 16) / 16.0) * _STEPS)
    return np.where(n < 16, n, np.minimum(large, 255)).astype(np.uint16)


def _seen(n: np.ndarray) -> np.ndarray:
    return ((n > 0.5).astype(np.int8) + (n > 3.5) + (n > 31.5)).astype(np.int8)


def _stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)


_N0, _N1 = np.repeat(_COUNT_OF, 256), np.tile(_COUNT_OF, 256)
#: By a slot's code, which is 256 * code of n0 + code of n1: stretched probability and how often it was seen (0 to 3). The second set is by
#: 65536 * bit + code, with that bit's own count taken out.
STRETCHED, SEEN = _stretched(_N0, _N1), _seen(_N0 + _N1)
_LESS0, _LESS1 = np.maximum(_N0 - 1, 0), np.maximum(_N1 - 1, 0)
STRETCHED_LESS, SEEN_LESS = np.concatenate([_stretched(_LESS0, _N1), _stretched(_N0, _LESS1)]), np.concatenate([_seen(_LESS0 + _N1), _seen(_N0 + _LESS1)])


def _mapped(shape: tuple, dtype) -> np.ndarray:
    """Zeros in a file of the temporary folder that goes when the array does."""
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, dtype, "w+", shape=shape))


class BitModel:
    """Huffman code, hashed count tables and mixer for one kind of symbol.

    sizes: log2 of the slots of each context's table. A context is a uint64 for each symbol to be coded.
    """

    GATES, BINS = 64, 33

    def __init__(self, counts: np.ndarray, sizes: tuple[int, ...]):
        self.start, self.length, nodes, self.bits = huffman(counts)
        self.nodes, self.places = lines(self.start, self.length, nodes, self.bits)
        self.coded_bits = float(np.dot(self.length, np.asarray(counts, np.float64)))
        self.sizes = sizes
        self.base = np.concatenate([[0], np.cumsum([1 << s for s in sizes])]).astype(np.int64)
        self.n0 = self.n1 = self.table = self.file = None
        self.weights = np.full((len(sizes), self.GATES), 0.35)
        self.refine = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, self.BINS))), (4, 1))

    def expand(self, symbols: np.ndarray) -> tuple:
        """Bits of each symbol, and for each bit: depth, node that its line is of, place in the line, bit."""
        n = self.length[symbols]
        ends = np.cumsum(n)
        number = np.arange(ends[-1] if len(ends) else 0)
        depth = number - np.repeat(ends - n, n)
        at = number + np.repeat(self.start[symbols] - (ends - n), n)
        return n, depth, np.take(self.nodes, at), np.take(self.places, at), np.take(self.bits, at)

    def slots(self, k: int, context: np.ndarray, n: np.ndarray, node: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of table k, without its base. (context + node) times a factor, whose context's part is worked out once a symbol; the place
        changes its last bits, so a line's slots lie together, and any two slots of different lines meet as seldom as random ones."""
        factor = np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        h = np.repeat(context * factor, n)
        h += node * factor
        h >>= np.uint64(64 - self.sizes[k])
        h ^= place
        return h.view(np.int64)

    def pieces(self, symbols: np.ndarray, bits: int | None = None):
        """Ranges of symbols with about _BITS bits each."""
        ends = np.cumsum(self.length[symbols])
        at = 0
        while at < len(symbols):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (bits or _BITS), "right")))
            yield at, to
            at = to

    def count(self, symbols: np.ndarray, contexts: list[np.ndarray], into: np.ndarray) -> None:
        """into: (slots, 2), how often each slot saw a 0 and a 1."""
        flat, one = into.reshape(-1), into.dtype.type(1)
        for at, to in self.pieces(symbols):
            n, _, node, place, bit = self.expand(symbols[at:to])
            for k, c in enumerate(contexts):
                cell = self.slots(k, c[at:to], n, node, place)
                cell <<= 1
                cell += bit
                np.add.at(flat[2 * self.base[k] : 2 * self.base[k + 1]], cell, one)

    def new_counts(self) -> np.ndarray:
        return _mapped((int(self.base[-1]), 2), np.uint32)

    def set_counts(self, n0: np.ndarray, n1: np.ndarray) -> None:
        self.n0, self.n1 = n0, n1
        self.table = _mapped((len(n0),), np.uint16)
        for k in range(0, len(n0), 1 << 20):
            s = slice(k, k + (1 << 20))
            self.table[s] = 256 * _count_codes(n0[s]) + _count_codes(n1[s])

    def finish(self) -> None:
        """Nothing is learned any more."""
        self.weights = self.weights.astype(np.float32)
        self.n0 = self.n1 = None

    def send(self, spark) -> str:
        """The table's codes as a file that each machine fetches once and its tasks map. Returns the driver's path."""
        self.file = f"chronoloom-lm-{uuid.uuid4().hex}"
        path = os.path.join(tempfile.gettempdir(), self.file)
        self.table.astype("<u2", copy=False).tofile(path)
        spark.sparkContext.addFile(path)
        return path

    def arrays(self) -> dict:
        """Code, weights and map for bitcode; of the tables their file's name."""
        types = {"start": "<i4", "length": "i1", "nodes": "<i4", "places": "i1", "bits": "i1", "sizes": "<i4", "weights": "<f8", "refine": "<f4"}
        return {k: np.asarray(getattr(self, k)).astype(t) for k, t in types.items()} | {"file": self.file or "", "levels": LEVELS}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"n0": None, "n1": None, "table": None}

    def _gate(self, depth, seen_a, seen_b):
        return (np.minimum(depth, 3) * 16 + seen_a * np.int8(4) + seen_b).astype(np.intp)

    def _mix(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = np.take(self.weights[0], gate, mode="clip") * inputs[0]
        for k in range(1, len(inputs)):
            w = np.take(self.weights[k], gate, mode="clip")
            w *= inputs[k]
            z += w
        return np.clip(z, -12, 12, out=z)

    def _bin(self, z: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(z, -8, 8) + 8) * ((self.BINS - 1) / 16)).astype(np.int64)

    def learn(self, symbols: np.ndarray, contexts: list[np.ndarray], rate: float = 0.02, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """One online pass over symbols that are in the counts; each bit's own count is taken out. Returns the bits that each gate saw, and the hits and ones of the map's cells."""
        gates, hits, found = np.zeros(self.GATES), np.zeros(self.refine.shape), np.zeros(self.refine.shape)
        start, weights = self.refine, self.weights.astype(np.float64)
        for at, to in self.pieces(symbols):
            size, depth, node, place, bit = self.expand(symbols[at:to])
            own = bit.astype(np.int32) << 16
            inputs, seen = [], []
            for k, c in enumerate(contexts):
                code = np.take(self.table[self.base[k] : self.base[k + 1]], self.slots(k, c[at:to], size, node, place)) | own
                inputs.append(np.take(STRETCHED_LESS, code))
                if k in (len(contexts) - 3, len(contexts) - 1):
                    seen.append(np.take(SEEN_LESS, code))
            gate = self._gate(depth, seen[1], seen[0])
            for i in range(0, len(bit), step):
                s = slice(i, i + step)
                g, x = gate[s], [v[s] for v in inputs]
                self.weights = weights.astype(np.float32)
                z = self._mix(x, g)
                error = bit[s] - 1 / (1 + np.exp(-z))
                n = np.bincount(g, minlength=self.GATES)
                gates += n
                n = rate / np.sqrt(np.maximum(n, 1))
                for k, v in enumerate(x):
                    weights[k] += n * np.bincount(g, error * v, self.GATES)
                cell = (g >> 4) * self.BINS + self._bin(z)
                hits += np.bincount(cell, minlength=hits.size).reshape(hits.shape)
                found += np.bincount(cell, bit[s], hits.size).reshape(hits.shape)
        self.weights, self.refine = weights, (found + 20 * start) / (hits + 20)
        return gates, hits, found

    def join(self, learned: list[tuple]) -> None:
        """Takes what tasks learned from this model's weights: (weights, gates, hits, ones) of each."""
        gates = sum((g for _, g, _, _ in learned), np.zeros(self.GATES))
        moved = sum(((w - self.weights) * g for w, g, _, _ in learned), np.zeros(self.weights.shape))
        self.weights = self.weights + moved / np.maximum(gates, 1)
        hits, found = (sum((x[k] for x in learned), np.zeros(self.refine.shape)) for k in (2, 3))
        self.refine = (found + 20 * self.refine) / (hits + 20)

    def log10_probabilities(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """For each symbol."""
        out = np.zeros(len(symbols))
        refine = self.refine.ravel().astype(np.float32)
        for at, to in self.pieces(symbols):
            n, depth, node, place, bit = self.expand(symbols[at:to])
            inputs, seen = [], []
            for k, c in enumerate(contexts):
                code = np.take(self.table[self.base[k] : self.base[k + 1]], self.slots(k, c[at:to], n, node, place))
                inputs.append(np.take(STRETCHED, code))
                if k in (len(contexts) - 3, len(contexts) - 1):
                    seen.append(np.take(SEEN, code))
            gate = self._gate(depth, seen[1], seen[0])
            z = self._mix(inputs, gate)
            p = np.take(refine, (gate >> 4) * self.BINS + self._bin(z), mode="clip")
            p += 1 / (1 + np.exp(-z))
            p *= np.float32(0.5)
            p = np.clip(np.where(bit == 1, p, 1 - p), np.float32(1e-7), 1)
            np.log10(p, out=p)
            starts = np.cumsum(n) - n
            if (n > 0).all():
                out[at:to] = np.add.reduceat(p, starts, dtype=np.float64)
            else:  # a code of one symbol has no bits
                out[at:to] = np.bincount(np.repeat(np.arange(to - at), n), p, to - at)
        return out


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h << np.uint64(17)  # room for the node


#: log2 of the slots of the tables, for symbols and for letters, up to TABLE_BITS counted bits; the slots double with them.
WORD_TABLES, LETTER_TABLES, TABLE_BITS = (17, 17, 18, 19, 18, 19), (10, 17, 18, 18, 18, 19, 19), 1 << 28


def grown(sizes: tuple[int, ...], bits: float) -> tuple[int, ...]:
    """sizes for a table in which so many bits are counted."""
    more = max(0, math.ceil(math.log2(max(bits, 1) / TABLE_BITS)))
    return tuple(s + more for s in sizes)


def word_contexts(texts: list[np.ndarray], class_of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids of all texts joined, and the contexts of each token from the tokens before it in its text.

    ids: 0 spelled, 1 end, then vocabulary rank + 2. Three ends stand before each text, so no context reaches into another.
    """
    pad = np.ones(3, np.int64)
    ids = np.concatenate([x for t in texts for x in (pad, t)])
    size = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    scored = np.ones(len(ids), bool)
    first = np.cumsum(size) - size
    for k in range(3):
        scored[first + k] = False
    at = np.flatnonzero(scored)
    sym = class_of[ids]
    frequent = np.flatnonzero((sym != SPELLED) & (sym != MID))
    last = np.searchsorted(frequent, at) - 1
    one, two, before = sym[at - 1], sym[at - 2], ids[at - 1]
    zero = np.zeros(len(at), np.int64)
    return ids[at], [_hash(zero), _hash(one), _hash(one, two), _hash(before), _hash(sym[frequent[last]], sym[frequent[last - 1]]), _hash(before, ids[at - 2])]


def letter_contexts(letters: np.ndarray, first: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Contexts of each letter from those before it in its word. letters: byte + 1 of all words joined, each with 0 at its end; first: where words begin; before: id of the token before each word."""
    n = len(letters)
    pos = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    back = []
    for k in range(1, 5):
        prev = np.zeros(n, np.int64)
        prev[k:] = letters[:-k]
        back.append(np.where(pos >= k, prev + 1, 0))
    power = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    np.multiply.accumulate(power, out=power)
    term = (letters.astype(np.uint64) + np.uint64(7)) * power
    total = np.cumsum(term) - term
    whole = total - np.repeat(total[first], np.diff(np.append(first, n)))
    inverse = np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    np.multiply.accumulate(inverse, out=inverse)
    whole = whole * np.repeat(inverse[first], np.diff(np.append(first, n)))
    at = np.minimum(pos, 12)
    return [_hash(at), _hash(back[0]), _hash(back[0], back[1]), _hash(*back[:3]), _hash(*back), _hash(whole, at), _hash(whole, at, np.repeat(before, np.diff(np.append(first, n))) + 1)]


def sized_model(counts: np.ndarray, sizes: tuple[int, ...]) -> BitModel:
    """A model whose tables suit the bits of so many symbols."""
    model = BitModel(counts, sizes)
    return BitModel(counts, grown(sizes, model.coded_bits))


class Lm:
    """Vocabulary, the two bit models and the base's constants."""

    def __init__(self, vocabulary: list[bytes], counts: list[int], ends: int, spelled: int, total: int, distinct: int):
        self.rank = {w: k + 2 for k, w in enumerate(vocabulary)}
        n = len(vocabulary)
        self.counts = np.concatenate([[0, ends], np.array(counts, np.int64)]).astype(np.float64)
        self.total, self.distinct, self.ends = total, distinct, ends
        self.class_of = np.full(n + 2, MID, np.int64)
        self.class_of[:2] = SPELLED, END
        head = min(HEAD, n)
        self.class_of[2 : 2 + head] = 3 + np.arange(head)
        self.base_log = np.log10(self.counts + 0.5)
        self.words = sized_model(np.concatenate([[spelled], self.counts[1:]]), WORD_TABLES)
        self.letters: BitModel | None = None
        self.spelled, self.new = spelled, 1.0
        self.files: list[str] = []

    def arrays(self) -> dict:
        """What bitcode's passes read."""
        words = list(self.rank)  # by rank
        out = {"vocabulary": b"".join(words), "ends": np.cumsum([len(w) for w in words]).astype("<i4"), "classes": self.class_of.astype("<i4"), "base_log": self.base_log.astype("<f8"), "texts": self.ends}
        for name, m in (("words.", self.words), ("letters.", self.letters)):
            out |= {name + k: v for k, v in m.arrays().items()}
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Vocabulary numbers of the words, and the end."""
        out = np.ones(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.rank.get, words, itertools.repeat(0)), np.int64, len(words))
        return out


def _batches_of(texts: list, lm: Lm):
    """Runs of whole texts of about _TOKENS tokens: [(number of the text, words, ids)]."""
    held, size = [], 0
    for k, t in enumerate(texts):
        words = words_of(t)
        held.append((k, words, lm.ids(words)))
        size += len(words) + 1
        if size >= _TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame) -> DataFrame:
    """h, token, c (count in training texts; 0 for words of held-out texts alone); a written table."""
    rows = docs.select("text", is_remainder(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"))

    def run(batches):
        train: Counter = Counter()
        other: set = set()

        def flush():
            for w in other:
                train.setdefault(w, 0)
            tokens, counts = list(train), list(train.values())
            for k in range(0, len(tokens), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[k : k + 50_000], pa.binary()).cast(pa.string()), pa.array(counts[k : k + 50_000], pa.int64())], ["token", "c"])
            train.clear()
            other.clear()

        for b in batches:
            for text, held_out in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist(), strict=True):
                if held_out:
                    other.update(words_of(text))
                else:
                    train.update(words_of(text))
                if len(train) + len(other) > 800_000:
                    yield from flush()
        yield from flush()

    counted = rows.mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    return materialize(counted.select(F.xxhash64("token").alias("h"), "token", "c"), "lm-tokens")


def _packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // n])


def _gather(parts: DataFrame, model: BitModel) -> None:
    """Sum the tasks' tables, a block of slots at a time, and put the sums in the model; the driver maps them and gets them a partition at a time."""

    def add(key, rows):
        total = np.zeros(2 * _BLOCK, np.uint32)
        for cells, x in zip(rows.column("cells").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            at = np.frombuffer(cells, np.uint16) if cells else None
            total[slice(None) if at is None else at] += _unpacked(x, 2 * _BLOCK if at is None else len(at))
        return pa.table({"model": pa.array([0], pa.int32()), "block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([b""], pa.binary()), "counts": pa.array([_packed(total)], pa.binary())})

    total = model.new_counts()
    for row in parts.groupBy("block").applyInArrow(add, _TABLE).toLocalIterator():
        found = _unpacked(row["counts"], 2 * _BLOCK).reshape(-1, 2)
        into = total[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK]
        into[:] = found[: len(into)]
    model.set_counts(total[:, 0], total[:, 1])


def _table_rows(counts: np.ndarray, model: int = 0):
    """What bitcode's counting gives of a table: blocks of slots; empty blocks aren't sent, and of sparse ones the cells that aren't 0, so a task sends no more than it counted."""
    flat = counts.reshape(-1)
    for k in range(0, len(flat), 32 * _BLOCK):
        rows = []
        for at in range(k, min(k + 32 * _BLOCK, len(flat)), 2 * _BLOCK):
            part = np.zeros(2 * _BLOCK, np.uint32)
            part[: len(flat) - at] = flat[at : at + 2 * _BLOCK]
            cells = np.flatnonzero(part).astype(np.uint16)
            if len(cells):
                whole, few = _packed(part), _packed(part[cells])
                rows.append((at // (2 * _BLOCK), *((cells.tobytes(), few) if 2 * len(cells) + len(few) < len(whole) else (b"", whole))))
        block, cell, count = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([model] * len(rows), pa.int32()), pa.array(block, pa.int32()), pa.array(cell, pa.binary()), pa.array(count, pa.binary())], ["model", "block", "cells", "counts"])


_BLOCK, _TABLE = 4096, "model int, block int, cells binary, counts binary"


def _least_count(able: DataFrame) -> int:
    """A count that VOCABULARY words reach and not many more: from a histogram with 16 bins for each doubling, so that the top-k reads few rows."""
    held = 0
    for _, n, least in sorted(able.groupBy(F.floor(F.log2("c") * 16).alias("b")).agg(F.count("*"), F.min("c")).collect(), reverse=True):
        held += n
        if held >= VOCABULARY:
            return least
    return 0


def fit(docs: DataFrame, tokens: DataFrame) -> Lm:
    """Learns from the training texts; returns a model for scoring."""
    spark = docs.sparkSession
    training = docs.select("doc_id", "text").where(~is_remainder(F.col("doc_id"), FOLDS, HELD_OUT))
    ends = training.count()
    seen = tokens.where("c > 0")
    total, distinct = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # at most VOCABULARY words of at most WORD_BYTES bytes come to the driver
    able = seen.where((F.octet_length("token") <= WORD_BYTES) & (F.col("c") >= LEAST_COUNT))
    top = able.where(F.col("c") >= _least_count(able)).orderBy(F.desc("c"), "token").limit(VOCABULARY).select("token", "c").toArrow()
    words, counts = [w.encode() for w in top.column("token").to_pylist()], top.column("c").to_pylist()
    lm = Lm(words, counts, ends, total - sum(counts), total + ends, distinct + (ends > 0))
    once = seen.where("c = 1").count()
    lm.new = min(max(once / lm.spelled, 0.02), 0.98) if once else 1.0
    lm.letters = _letter_model(lm, seen)
    # a task for each core, as each has tables of its own
    texts = training.select(F.col("text").cast("binary"))
    counted = bitcode.over_texts(texts.coalesce(max(1, spark.sparkContext.defaultParallelism)), bitcode.COUNT, lm.arrays(), _TABLE)
    tables = materialize(counted, "lm-tables")
    _gather(tables.where("model = 0"), lm.words)
    _gather(tables.where("model = 1"), lm.letters)
    discard(tables)
    # the weights to begin with: SAMPLE_TEXTS texts, whatever their length
    able = training.where("text is not null")
    ids = F.broadcast(sample_ids(able, SAMPLE_TEXTS, 41))
    sample = sorted(one_text(able.join(ids, "doc_id"), "doc_id").select("text").toArrow().column("text").to_pylist())
    for held in _batches_of(sample, lm):
        _learn(lm, held, 0.02, 2048)
    lm.files = [m.send(spark) for m in (lm.words, lm.letters)]
    learning = lm.arrays() | {"stretched": STRETCHED_LESS, "seen": SEEN_LESS, "rate": 0.005, "step": 8192}
    learned = bitcode.over_texts(texts, bitcode.LEARN, learning, "model int, weights binary, gates binary, hits binary, ones binary").collect()
    for k, m in enumerate((lm.words, lm.letters)):
        shapes = m.weights.shape, (m.GATES,), m.refine.shape, m.refine.shape
        parts = sorted(tuple(bytes(x) for x in r[1:]) for r in learned if r.model == k)  # in the same order on every run
        m.join([tuple(np.frombuffer(x).reshape(shape) for x, shape in zip(r, shapes, strict=True)) for r in parts])
    lm.words.finish()
    lm.letters.finish()
    return lm


def _learn(lm: Lm, held: list, rate: float, step: int) -> list:
    """Learns from a run of texts; for the words' and the letters' model what learn() returns, or 0."""
    ids, contexts = word_contexts([i for _, _, i in held], lm.class_of)
    out = [lm.words.learn(ids, contexts, rate, step), 0]
    for letters, _, contexts in _spelled(held):
        out[1] = _added([out[1]], [lm.letters.learn(letters, contexts, rate, step)])[0]
    return out


def _added(a: list, b: list) -> list:
    return [x if not y else y if not x else tuple(p + q for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True)]


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(size) - size
    letters = joined.astype(np.int64) + 1
    letters[first + size - 1] = 0
    return letters, first


def _word_parts(words: list[bytes]):
    """Runs of words with about _TOKENS letters."""
    at = size = 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= _TOKENS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(words):
        yield at, len(words)


def _spelled(held: list):
    """letters, where words begin, and contexts of the spelled words of texts, in order, for runs of words."""
    words, before = [], []
    for _, own, ids in held:
        at = np.flatnonzero(ids == SPELLED)
        words += [own[k] for k in at.tolist()]
        before.append(np.where(at > 0, ids[at - 1], END))
    before = np.concatenate(before) if before else np.zeros(0, np.int64)
    for at, to in _word_parts(words):
        letters, first = _letters(words[at:to])
        yield letters, first, letter_contexts(letters, first, before[at:to])


def _letter_model(lm: Lm, seen: DataFrame) -> BitModel:
    """Huffman codes of the letters by their count in the spelled words of training texts."""
    known = seen.sparkSession.sparkContext.broadcast(lm.rank)

    def letters_of(batches):
        total = np.zeros(257)
        for b in batches:
            pairs = [(w, c) for t, c in zip(b.column("token").to_pylist(), b.column("c").to_pylist(), strict=True) if (w := t.encode()) not in known.value]
            words, weight = [w for w, _ in pairs], np.array([c for _, c in pairs], np.float64)
            for at, to in _word_parts(words):
                letters, first = _letters(words[at:to])
                total += np.bincount(letters, np.repeat(weight[at:to], np.diff(np.append(first, len(letters)))), 257)
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(total)], ["s", "n"])

    counts = np.zeros(257)
    for s, n in seen.select("token", "c").mapInArrow(letters_of, "s int, n double").groupBy("s").agg(F.sum("n")).collect():
        counts[s] = n
    known.unpersist()
    return sized_model(counts, LETTER_TABLES)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each text."""
    spark = docs.sparkSession
    tokens = token_counts(docs)
    lm = fit(docs, tokens)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", is_remainder(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), F.col("text").cast("binary"))
    schema = f"rid bigint, doc_id {doc_type}, held_out boolean, n_tokens bigint, known bigint, base double, logp double, size bigint, rest array<struct<h:bigint,spell:double>>"
    scoring = lm.arrays() | {"stretched": STRETCHED, "seen": SEEN, "rate": 0.0, "step": 1}
    part = materialize(bitcode.over_texts(rows, bitcode.SCORE, scoring, schema), "lm-part")
    for path in lm.files:  # emptied, not removed: an executor that starts later fetches all files that were added
        os.truncate(path, 0)
    links = part.select("rid", F.inline("rest"))
    by_letters = F.pow(F.lit(10.0), F.greatest("spell", F.lit(-300.0)))
    by_count = F.lit(1 - lm.new) * F.col("c") / F.lit(float(max(lm.spelled, 1)))
    spelled = F.log10(by_count + F.lit(lm.new) * by_letters) if lm.new < 1 else F.col("spell")
    added = links.join(tokens.select("h", "c"), "h").groupBy(F.col("rid").alias("r")).agg(
        F.sum((F.col("c") > 0).cast("bigint")).alias("known2"), F.sum(F.log10(F.col("c") + 0.5)).alias("base2"), F.sum(spelled).alias("spell2")
    )
    out = part.drop("rest").join(added, F.col("rid") == F.col("r"), "left")
    zero = F.lit(0.0)
    bottom = math.log10(lm.total + 0.5 * (lm.distinct + 1))
    total = F.col("logp") + F.coalesce("spell2", zero)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(lm.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), total.alias("score"), (-total * math.log2(10) / F.greatest(F.col("size"), F.lit(1))).alias("bits_per_byte"),
    )
