"""Language-model scores by online logistic context mixing over bits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import bounded_batches, column_of, give_back, held, mix, pack, pack_sorted, slices, unpack, unpack_sorted, written

#: Contexts of a byte within its word: the 1 to 4 bytes before it, and all of the word before it.
ORDERS = 5
#: Odd multiplier of the rolling sum over the bytes of a word, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C1D
INVERSE = pow(BASE, -1, 2**64)
END = b"\n"
#: Sets of mixing weights for bytes: by how often the word so far, and the four bytes before, were seen with these bits.
GATES = 24
STEPS = 33  # of the adaptive refinement, over stretched probabilities from -8 to 8
#: Bytes of text for each bucket of words, and for each group of documents.
BUCKET_BYTES, GROUP_BYTES = 8 << 20, 8 << 20


# Words, their bytes and the contexts of these.


def hashes_of(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w, 4) for w in words]), dtype="<u8")


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of each text (words in lower case A-Z, then an end): how many, the distinct ones' hashes in order, which of
    them each token is, and the distinct ones themselves (the end as b"")."""
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    split = pc.ascii_split_whitespace(clean)
    n = np.where(np.array(pc.binary_length(clean)) > 0, np.array(pc.list_value_length(split)), 0).astype(np.int64)
    flat = split.flatten().cast(pa.binary())
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
    words = [*flat.dictionary.to_pylist(), b""]
    hashes = hashes_of(words)
    order = np.argsort(hashes)
    place = np.empty(len(words), dtype=np.int32)
    place[order] = np.arange(len(words))
    lengths = n + 1
    at = np.full(lengths.sum(), place[-1], dtype=np.int32)
    inside = np.ones(len(at), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    at[inside] = place[np.array(flat.indices)]
    return lengths, hashes[order], at, [words[i] for i in order.tolist()]


def pair_keys(hashes: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the place in hashes of the token before it (the end before a text), and the key of both."""
    before = np.empty(len(at), dtype=at.dtype)
    before[1:] = at[:-1]
    before[np.cumsum(lengths) - lengths] = np.searchsorted(hashes, hashes_of([b""])[0])
    return before, mix(mix(hashes)[before] + hashes[at])


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, each with a space after it (the end is one line feed), and how many each has."""
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    raw = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8).copy()
    raw[(np.cumsum(lengths) - lengths)[lengths == 1]] = END[0]
    return raw, lengths


def context_keys(raw: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """For each byte 56 bits of a hash of its context of an order, and the byte."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.arange(len(raw)) - starts
    keys = raw.astype(np.uint64)
    if order == ORDERS - 1:
        up, down = _powers(len(raw) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((keys + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
        context = (sums[:-1] - sums[starts]) * down[starts]
    else:
        context = np.zeros(len(raw), dtype=np.uint64)
        for k in range(1, order + 2):
            context[k:] |= np.where(inside[k:] >= k, keys[:-k] + np.uint64(1), np.uint64(0)) << np.uint64(9 * (k - 1))
    return mix(mix(context + np.uint64(order)) + np.uint64(order)) & ~np.uint64(255) | keys


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = held(("lm", "powers"), dict)
    if len(kept.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            kept[name] = np.multiply.accumulate(steps)
    return kept["up"], kept["down"]


class Code:
    """A prefix code of bytes: frequent ones take few binary decisions. Every inner node of its tree is a context of its own."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, byte, byte) for byte, n in enumerate(counts)]
        heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (a, _, x), (b, _, y) = heappop(heap), heappop(heap)
            children[node] = (x, y)
            heappush(heap, (a + b, node, node))
        paths: dict[int, list[tuple[int, int]]] = {510: []}
        for node in range(510, 255, -1):
            for bit, child in enumerate(children[node]):
                paths[child] = [*paths[node], (510 - node, bit)]
        self.length = np.array([len(paths[b]) for b in range(256)])
        self.start = np.cumsum(self.length) - self.length
        self.nodes = np.array([n for b in range(256) for n, _ in paths[b]])
        self.bits = np.array([x for b in range(256) for _, x in paths[b]])

    def decisions(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each binary decision of the lowest byte of each key: the key's place, the node, the bit."""
        byte = (keys & np.uint64(255)).astype(np.int64)
        n = self.length[byte]
        of = np.repeat(np.arange(len(keys)), n)
        at = np.arange(len(of)) + np.repeat(self.start[byte] - np.cumsum(n) + n, n)
        return of, self.nodes[at], self.bits[at]


def node_counts(keys: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones in the context and node of each decision of distinct sorted keys with their counts."""
    of, nodes, bit = code.decisions(keys)
    context = np.cumsum(np.concatenate(([0], keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)))) if len(keys) else np.zeros(0, dtype=np.int64)
    _, slot = np.unique(context[of] * 256 + nodes, return_inverse=True)
    c = counts.astype(np.float64)[of]
    return np.bincount(slot, weights=c * (bit == 0))[slot], np.bincount(slot, weights=c * (bit == 1))[slot]


def squeeze(n: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact up to 8, then five steps for each doubling."""
    return np.round(5 * np.log2(1 + n)).astype(np.uint8)


def unsqueeze(code: np.ndarray) -> np.ndarray:
    return np.round(np.exp2(np.arange(256) / 5) - 1).astype(np.float32)[code]


# Mixing.


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def evidence(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretched probability of a one after such counts (0 after none), and how sure it is in six levels."""
    x = np.log((ones + np.float32(0.02)) / (zeros + np.float32(0.02)))
    return np.clip(x, -8, 8).astype(np.float32), np.searchsorted(np.array([0.5, 1.5, 3.5, 15.5, 127.5], dtype=np.float32), zeros + ones).astype(np.uint8)


@cache
def evidence_table() -> tuple[np.ndarray, np.ndarray]:
    """evidence() for all pairs of counts in a byte: as they are, with a zero less, with a one less."""
    n = unsqueeze(np.arange(256))
    rows = [evidence(np.maximum(n[:, None] - a, 0).repeat(256, axis=1).ravel(), np.tile(np.maximum(n - b, 0), 256)) for a, b in ((0, 0), (1, 0), (0, 1))]
    return np.concatenate([x for x, _ in rows]), np.concatenate([s for _, s in rows])


class Mixer:
    """Weights for each gate over stretched predictions, and a refinement of the result for each node; both learned online."""

    def __init__(self, inputs: int, gates: int, nodes: int, values: np.ndarray | None = None):
        cut = gates * (inputs + 1)
        self.shape = (inputs, gates, nodes)
        if values is None:
            self.weights = np.full((gates, inputs + 1), 1.5 / inputs)
            self.weights[:, -1] = 0
            self.refinement = np.tile(squash(np.linspace(-8, 8, STEPS)), (nodes, 1))
        else:
            self.weights, self.refinement = values[:cut].reshape(gates, inputs + 1), values[cut:].reshape(nodes, STEPS)

    def values(self) -> np.ndarray:
        return np.concatenate((self.weights.ravel(), self.refinement.ravel()))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        out = 0.3 * weights[gate, -1]
        for k in range(len(x)):
            out += x[k] * weights[gate, k]
        return out

    def refine(self, s: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.clip(s, -7.999, 7.999) + 8) * ((STEPS - 1) / 16)
        low = at.astype(np.int64)
        share = at - low
        flat, cell = self.refinement.ravel(), nodes * STEPS + low
        return cell, share, flat[cell] * (1 - share) + flat[cell + 1] * share

    def learn(self, x: np.ndarray, gate: np.ndarray, nodes: np.ndarray, bit: np.ndarray, weight: np.ndarray, batch: int = 10_000) -> None:
        """Online: batch by batch a step of the weights of each gate (scaled by past gradients), and of the refinement."""
        inputs, gates, n_nodes = self.shape
        squares = np.full(self.weights.shape, 1e-6)
        for start in range(0, len(bit), batch):
            own = slice(start, start + batch)
            g, c = gate[own], weight[own]
            s = self.mixed(x[:, own], g)
            wrong = (bit[own] - squash(s)) * c
            seen = np.maximum(np.bincount(g, weights=c, minlength=gates), 1e-9)
            rows = [*x[:, own], np.float32(0.3)]
            step = np.stack([np.bincount(g, weights=wrong * row, minlength=gates) for row in rows], axis=1) / seen[:, None]
            squares += step * step
            self.weights = self.weights + 0.05 * step / np.sqrt(squares)
            cell, share, _ = self.refine(s, nodes[own])
            cell = cell + (share > 0.5)
            n = np.bincount(cell, weights=c, minlength=n_nodes * STEPS).reshape(n_nodes, STEPS)
            ones = np.bincount(cell, weights=c * bit[own], minlength=n_nodes * STEPS).reshape(n_nodes, STEPS)
            self.refinement = self.refinement + 0.1 * n / (n + 200) * (ones / np.maximum(n, 1e-9) - self.refinement)

    def log10(self, x: np.ndarray, gate: np.ndarray, nodes: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit."""
        s = self.mixed(x, gate)
        p = np.clip(0.5 * squash(s) + 0.5 * self.refine(s, nodes)[2], 1e-6, 1 - 1e-6)
        return np.log10(np.where(bit == 1, p, 1 - p))


def averaged(parts: DataFrame, size: int) -> np.ndarray | None:
    """The mean of the learners' values (seen long, values array<double>) by what they saw; None without a learner.

    Summed as whole numbers, so the order of the learners doesn't matter.
    """
    scaled = F.round(F.col("value") * 2.0**40).cast("decimal(20,0)") * F.col("seen").cast("decimal(18,0)")
    rows = parts.select("seen", F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum(scaled).alias("total"), F.sum("seen").alias("seen"))
    rows = rows.collect()  # as many rows as the model has values
    if not rows:
        return None
    out = np.zeros(size)
    for r in rows:
        out[r["at"]] = int(r["total"]) / r["seen"] / 2.0**40
    return out


# Bytes of words: counts of contexts meet words by buckets of contexts, as words meet documents by buckets of words.


def _cut(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys."""
    b = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order], prepend=-1))
    return [(int(b[own[0]]), own) for own in np.split(order, cuts[1:])] if len(keys) else []


def _by(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], key: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in the first `key` columns."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(column_of(batch, c).to_pylist() for c in columns), strict=True):
            if row[:key] != last and rows:
                yield last, rows
                rows = []
            last = row[:key]
            rows.append(row[key:])
    if rows:
        yield last, rows


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


ASKED = "to int, b int, order int, keys binary, counts binary"
TOLD = "b int, order int, to int, data binary"


def contexts(vocabulary: DataFrame, code: Code, buckets: int) -> DataFrame:
    """b, order, to, data: for the words of bucket b the counts of their contexts (see node_counts) over all words.

    Every bucket of words sends its distinct contexts and bytes of each order, with the counts of training tokens, to the
    buckets of the contexts, and gets zeros and ones back for each, so no table of contexts is ever in one place.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b,), rows in _by(batches, ("b", "counts", "words")):
            for data, blob in rows:
                raw, lengths = spelled(unpack(blob, "u1").tobytes().split(b"\n"))
                c = np.repeat(unpack(data, "<u8"), lengths).astype(np.float64)
                for order in range(ORDERS):
                    keys, at = _sorted_distinct(context_keys(raw, lengths, order))
                    sums = np.bincount(at, weights=c).astype("<u8")
                    yield _rows(ASKED, [(to, b, order, pack_sorted(keys[own]), pack(sums[own])) for to, own in _cut(keys >> np.uint64(8), buckets)])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for (to, order), rows in _by(batches, ("to", "order", "b", "keys", "counts"), 2):
            sent = [unpack_sorted(k) for _, k, _ in rows]
            keys, at = _sorted_distinct(np.concatenate(sent))
            sums = np.bincount(at, weights=np.concatenate([unpack(c, "<u8") for *_, c in rows]).astype(np.float64))
            zeros, ones = map(squeeze, node_counts(keys, sums, code))
            n = code.length[(keys & np.uint64(255)).astype(np.int64)]
            starts = np.cumsum(n) - n
            cuts = np.cumsum([0, *map(len, sent)])
            for (b, *_), x, y in zip(rows, cuts[:-1], cuts[1:], strict=True):
                own = at[x:y]
                places = np.repeat(starts[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(n[own].sum())
                yield _rows(TOLD, [(b, order, to, pack(np.concatenate((zeros[places], ones[places]))))])

    asked = vocabulary.select("b", "counts", "words").mapInArrow(ask, ASKED)
    return asked.repartition(buckets, "to").sortWithinPartitions("to", "order").mapInArrow(tell, TOLD)


class Bytes:
    """The decisions of all bytes of a bucket's words, with the counts that were told for them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, code: Code, told: list[tuple[int, int, bytes]], buckets: int):
        raw, lengths = spelled(words)
        n = code.length[raw]
        of, nodes, bit = code.decisions(raw.astype(np.uint64))
        of, self.nodes, self.bit = of.astype(np.int32), nodes.astype(np.uint8), bit.astype(np.uint8)
        within = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)[of]
        self.counts = counts
        #: By order: zeros and ones of each decision in one number.
        self.seen: list[np.ndarray] = []
        for order in range(ORDERS):
            keys, at = _sorted_distinct(context_keys(raw, lengths, order))
            own = code.length[(keys & np.uint64(255)).astype(np.int64)]
            starts = np.cumsum(own) - own
            both = np.zeros(own.sum(), dtype=np.uint16)
            mine = dict(_cut(keys >> np.uint64(8), buckets))
            for _, to, data in (r for r in told if r[0] == order):
                k = mine[to]
                places = np.repeat(starts[k] - np.cumsum(own[k]) + own[k], own[k]) + np.arange(own[k].sum())
                zeros, ones = unpack(data, "u1").reshape(2, -1)
                both[places] = zeros.astype(np.uint16) << 8 | ones
            self.seen.append(both[starts[at].astype(np.int32)[of] + within])

    def inputs(self, own: slice, without: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions by order, and the gate, of some of the decisions of a slice; without: 1 leaves one occurrence of
        each out of its counts."""
        stretched, sure = evidence_table()
        shift = (without * (self.bit[own][some].astype(np.int32) + 1)) << 16
        x, level = np.empty((ORDERS, len(shift)), dtype=np.float32), []
        for order, both in enumerate(self.seen):
            at = both[own][some] + shift
            x[order] = stretched[at]
            level.append(sure[at])
        return x, level[-1].astype(np.int64) * 4 + np.minimum(level[-2], 3)

    def blocks(self, most: int = 200_000) -> Iterator[slice]:
        for start in range(0, len(self.bit), most):
            yield slice(start, min(start + most, len(self.bit)))

    def learn(self) -> tuple[int, np.ndarray]:
        """What a mixer learns from all training tokens of these words, each left out of its own counts."""
        mixer = Mixer(ORDERS, GATES, 255)
        for own in self.blocks():
            c = self.counts[self.word[own]].astype(np.float64)
            some = c > 0
            x, gate = self.inputs(own, 1, some)
            mixer.learn(x, gate, self.nodes[own][some].astype(np.int64), self.bit[own][some], c[some])
        return int(self.counts.sum()), mixer.values()

    def log10(self, mixer: Mixer, held_out: np.ndarray) -> np.ndarray:
        """log10 of each word's probability: to a training text, without one occurrence of the word, and to another (of words
        marked held_out alone)."""
        out = np.zeros((2, len(self.counts)))
        for own in self.blocks():
            word = self.word[own]
            first = int(word[0])
            for k, wanted in enumerate((self.counts > 0, held_out)):
                some = wanted[word]
                x, gate = self.inputs(own, 1 - k, some)
                prices = mixer.log10(x, gate, self.nodes[own][some].astype(np.int64), self.bit[own][some])
                prices = np.bincount(word[some] - first, weights=prices)
                out[k, first : first + len(prices)] += prices
        return out


# Pairs of words: does a word follow the one before it as it did elsewhere?

#: Contexts of that decision: how often the word before was seen and the last three decisions; the last 12; how often the
#: two words before were seen; how many of the last 16 were yes, and the last. Gates: how many of the last eight were yes.
PAIR_SIZES = (64 * 8, 1 << 12, 64 * 64, 34)
PAIR_GATES = 9


def pair_contexts(bit: np.ndarray, level: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four contexts (rows) and the gate of each token's decision, from the decisions and levels before it in its text."""
    inside = (np.arange(len(bit)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    past = np.zeros(len(bit), dtype=np.uint16)
    past[1:] = np.where(inside[1:] >= 1, bit[:-1], 0)
    for k in (1, 2, 4, 8):  # twice as many decisions each time
        older = np.where(inside[k:] >= k, past[:-k] << np.uint16(k), np.uint16(0))
        past[k:] |= older
    before = np.zeros(len(bit), dtype=np.int32)
    before[1:] = np.where(inside[1:] >= 1, level[:-1], 0)
    some, last = np.bitwise_count(past).astype(np.int32), (past & 1).astype(np.int32)
    level = level.astype(np.int32)
    rows = np.stack((level * 8 + (past & 7), (past & 4095).astype(np.int32), level * 64 + before, some * 2 + last))
    return rows, np.bitwise_count(past & np.uint16(255)).astype(np.int64)


def pair_inputs(tables: list[np.ndarray], at: np.ndarray, bit: np.ndarray, without: np.ndarray | int) -> np.ndarray:
    """Stretched predictions of each context's counts, less `without` (0 or 1) occurrences of the decision itself."""
    variant = (without * (bit + 1)).astype(np.int32)
    rows = []
    for table, place in zip(tables, at, strict=True):
        zeros, ones = table[:, 0].astype(np.float32), table[:, 1].astype(np.float32)
        made = np.concatenate([evidence(np.maximum(zeros - x, 0), np.maximum(ones - y, 0))[0] for x, y in ((0, 0), (1, 0), (0, 1))])
        rows.append(made[variant * len(table) + place])
    return np.stack(rows)


def _decisions(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decisions, levels of the word before, and tokens of each row."""
    flat = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    return flat & 1, flat >> 1, np.array([len(x) for x in blobs], dtype=np.int64)


def pair_model(features: DataFrame, n_tokens: int) -> tuple[list[np.ndarray], Mixer]:
    """Counts of all contexts over the training rows of features, and a mixer that learned from all of them."""
    sizes = [2 * n for n in PAIR_SIZES]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes), dtype=np.int64)
        for batch in batches:
            if len(batch):
                bit, level, lengths = _decisions(column_of(batch, "pairs").to_pylist())
                at, _ = pair_contexts(bit, level, lengths)
                total += np.concatenate([np.bincount(2 * row + bit, minlength=n) for row, n in zip(at, sizes, strict=True)])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    training = features.where("not held_out").select("doc_id", "pairs")
    flat = np.zeros(sum(sizes), dtype=np.int64)
    for r in training.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a fixed number of places
        flat[r["at"]] = r["n"]
    tables = [t.reshape(-1, 2) for t in np.split(flat, np.cumsum(sizes)[:-1])]
    fresh = lambda values=None: Mixer(len(PAIR_SIZES), PAIR_GATES, PAIR_GATES, values)

    def learn(table: pa.Table) -> pa.Table:
        mixer = fresh()
        rows = sorted(zip(table.column("order").to_pylist(), table.column("pairs").to_pylist(), strict=True))
        blobs = [x for _, x in rows]
        n = np.array([len(x) for x in blobs], dtype=np.int64)
        for x, y in slices(n, 1 << 19):
            bit, level, lengths = _decisions(blobs[x:y])
            at, gate = pair_contexts(bit, level, lengths)
            mixer.learn(pair_inputs(tables, at, bit, 1), gate, gate, bit, np.ones(len(bit)))
        return pa.table({"seen": pa.array([n.sum()], pa.int64()), "values": pa.array([mixer.values().tolist()], pa.list_(pa.float64()))})

    # The learners' number, and who learns what in which order, depend on the texts alone.
    learners = max(1, n_tokens >> 21)
    order = F.xxhash64("doc_id", "pairs")
    parts = training.withColumn("order", order).groupBy(F.pmod(order, F.lit(learners)).alias("learner")).applyInArrow(learn, "seen long, values array<double>")
    return tables, fresh(averaged(parts, len(fresh().values())))


# The scores.

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
MET = "kind int, b int, g int, keys binary, counts binary, words binary"
FEATURES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest double, n_bytes long, pairs binary"


def score(docs: DataFrame, folds: int = 10, bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text), by a model of the documents with crc32(doc_id) mod folds not 0.

    held_out: the remainder is 0. Tokens are words in lower case (A-Z) and one end. base_score: log10 of the unigram
    probability of the tokens, (c + 0.1) / (N + 0.1 (V + 1)), with n_known of them seen in training (c > 0) and train_tokens
    = N. score: log10 of the probability that the model gives the words, one space between, and the end.
    bits_per_byte: the same over n_bytes, the UTF-8 bytes of the text with its end.

    The model decides each token in bits. First: did the word follow the word before it elsewhere in training? If so, it
    costs its share of what followed; if not, it is spelled, each byte as decisions of a prefix code. Every decision mixes
    the counts of several hashed contexts (earlier decisions and word counts; 1 to 4 bytes before and the word so far)
    by weights of its gate, refined adaptively. Weights learn online over all training tokens, and a training document is
    scored, with its own occurrence left out of the counts; so texts that occur twice stand out.

    All counts (words, pairs of words, contexts) are exact and grow with the corpus. They lie in tables sharded by hash,
    bucket_bytes of text for each bucket: each group of documents (group_bytes of text, or one document) sends its
    distinct words and pairs once and gets their counts back. Rows between groups and buckets are never more than the words
    and pairs sent. The driver sees weights and counts of a fixed number of levels only. Results depend on neither
    partitions nor cores.

    Null text: empty, the end alone. A null id counts as the empty text: held out. Repeated rows each give a row (and count
    twice in training). Without training documents all counts are 0. An empty table gives no row.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.crc32(name.cast("binary")) % folds == 0).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets, groups = -(-size // bucket_bytes) or 1, -(-size // group_bytes) or 1
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        lengths, hashes, at, words = tokens_of(table.column("text").combine_chunks())
        training = np.repeat(~np.array(table.column("held_out")), lengths)
        g = table.column("g")[0].as_py()
        counts = np.bincount(at, weights=training, minlength=len(hashes)).astype("<u4")
        counts = counts << 1 | (np.bincount(at, weights=~training, minlength=len(hashes)) > 0)  # the lowest bit: held-out texts have it
        out = [(0, b, g, pack_sorted(hashes[own]), pack(counts[own]), pack(np.frombuffer(b"\n".join([words[i] for i in own.tolist()]), dtype=np.uint8))) for b, own in _cut(hashes, buckets)]
        places = _pair_places(pair_keys(hashes, at, lengths)[1], buckets)
        every, (seen, counts) = _runs_of(places)[0], _runs_of(places[training])
        known = np.zeros(len(every), dtype="<u4")
        known[np.searchsorted(every, seen)] = counts
        starts = np.flatnonzero(np.diff(every >> 40, prepend=-1))
        for own, n in zip(np.split(every, starts[1:]), np.split(known, starts[1:]), strict=True):
            out.append((1, int(own[0] >> 40), g, pack_sorted((own & int(PAIR_BITS)).astype("<u8")), pack(n), None))
        return pa.Table.from_batches([_rows(MET, out)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's totals back to each group; of words, which of the bucket's words they are, and the bucket's words as group -1."""
        give_back()
        for (kind, b), rows in _by(batches, ("kind", "b", "g", "keys", "counts", "words"), 2):
            sent = [unpack_sorted(k) for _, k, _, _ in rows]
            keys, at = _sorted_distinct(np.concatenate(sent))
            counts = np.concatenate([unpack(c, "<u4") for _, _, c, _ in rows])
            sums = np.bincount(at, weights=counts >> 1 if kind == 0 else counts).astype("<u8")
            if kind == 0:
                words = [w for *_, blob in rows for w in unpack(blob, "u1").tobytes().split(b"\n")]
                first = np.empty(len(keys), dtype=np.int64)
                first[at[::-1]] = np.arange(len(at))[::-1]
                words = b"\n".join([words[i] for i in first.tolist()])
                yield _rows(MET, [(kind, b, -1, None, pack(sums), pack(np.frombuffer(words, dtype=np.uint8)))])
            cuts = np.cumsum([0, *map(len, sent)])
            for (g, *_), x, y in zip(rows, cuts[:-1], cuts[1:], strict=True):
                own = at[x:y]
                places = pack_sorted((own << 1 | counts[x:y] & 1).astype("<u8")) if kind == 0 else None
                yield _rows(MET, [(kind, b, g, places, pack(sums[own]), None)])

    sent = grouped.groupBy("g").applyInArrow(ask, MET)
    met = written(sent.repartition(2 * buckets, "kind", "b").sortWithinPartitions("kind", "b").mapInArrow(meet, MET), "words")
    vocabulary = met.where("kind = 0 and g = -1")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(258, dtype=np.int64)  # bytes, then kinds and tokens
        for batch in batches:
            for data, blob in zip(column_of(batch, "counts").to_pylist(), column_of(batch, "words").to_pylist(), strict=True):
                raw, lengths = spelled(unpack(blob, "u1").tobytes().split(b"\n"))
                c = unpack(data, "<u8")
                found[:256] += np.bincount(raw, weights=np.repeat(c, lengths), minlength=256).astype(np.int64)
                found[256:] += np.array([(c > 0).sum(), c.sum()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(258)), pa.array(found)], names=["at", "n"])

    found = np.zeros(258, dtype=np.int64)
    for r in vocabulary.mapInArrow(totals, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        found[r["at"]] = r["n"]
    code, kinds, tokens = Code(found[:256]), int(found[256]), int(found[257])
    told = written(contexts(vocabulary, code, buckets), "contexts")

    #: A bucket's words (step -1), the counts of their contexts (by order), and the groups that have some of its words (ORDERS).
    fields = "b int, step int, to int, data binary, words binary"
    none = F.lit(None).cast("binary")
    own_words = vocabulary.select("b", F.lit(-1).alias("step"), F.lit(0).alias("to"), F.col("counts").alias("data"), "words")
    of_contexts = told.select("b", F.col("order").alias("step"), "to", "data", none.alias("words"))
    of_groups = met.where("kind = 0 and g >= 0").select("b", F.lit(ORDERS).alias("step"), F.col("g").alias("to"), F.col("keys").alias("data"), none.alias("words"))

    def bucketed(parts: DataFrame, run: Callable, schema: str) -> DataFrame:
        return parts.repartition(buckets, "b").sortWithinPartitions("b", "step").mapInArrow(run, schema)

    def read(rows: list[tuple]) -> Bytes:
        (_, _, data, blob), *others = rows
        return Bytes(unpack(blob, "u1").tobytes().split(b"\n"), unpack(data, "<u8"), code, [r[:3] for r in others if r[0] < ORDERS], buckets)

    names = tuple(f.split()[0] for f in fields.split(", "))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by(batches, names):
            seen, values = read(rows).learn()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([values.tolist()], pa.list_(pa.float64()))], names=["seen", "values"])

    fresh = lambda values=None: Mixer(ORDERS, GATES, 255, values)
    learned = averaged(bucketed(own_words.union(of_contexts), learn, "seen long, values array<double>"), len(fresh().values()))

    replies_schema = "g int, kind int, b int, counts binary, prices binary"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = fresh(learned)
        for (b,), rows in _by(batches, names):
            some = read(rows)
            asked = [(g, unpack_sorted(data).astype(np.int64)) for step, g, data, _ in rows if step == ORDERS]
            held_out = np.zeros(len(some.counts), dtype=bool)
            for _, at in asked:
                held_out[at[at & 1 == 1] >> 1] = True
            prices = some.log10(mixer, held_out).astype("<f4")
            for g, at in asked:
                at = at >> 1
                yield _rows(replies_schema, [(g, 0, b, pack(some.counts[at]), pack(prices[:, at]))])

    of_words = bucketed(own_words.union(of_contexts).union(of_groups), answer, replies_schema)
    of_pairs = met.where("kind = 1").select("g", "kind", "b", "counts", none.alias("prices"))
    replies = of_words.union(of_pairs)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in FEATURE_KINDS], names=[c.split()[0] for c in FEATURES.split(", ")])
        texts = left.column("text").combine_chunks()
        lengths, hashes, at, _ = tokens_of(texts)
        before, keys = pair_keys(hashes, at, lengths)
        keys, pair = _distinct(_pair_places(keys, buckets))
        c, prices, c2 = np.zeros(len(hashes)), np.zeros((2, len(hashes))), np.zeros(len(keys))
        mine = {(0, b): own for b, own in _cut(hashes, buckets)} | {(1, b): own for b, own in _pairs_cut(keys)}
        for kind, b, data, lp in zip(*(right.column(n).to_pylist() for n in ("kind", "b", "counts", "prices")), strict=True):
            own = mine[kind, b]
            if kind == 0:
                c[own] = unpack(data, "<u8")
                prices[:, own] = unpack(lp, "<f4").reshape(2, -1)
            else:
                c2[own] = unpack(data, "<u8")
        held_out = np.repeat(np.array(left.column("held_out")), lengths)
        followed, followers = c2[pair] - ~held_out, np.maximum(c[before] - ~held_out, 0)
        yes = followed > 0
        rest = np.where(yes, np.log10(np.maximum(followed, 1) / np.maximum(followers, 1)), np.where(held_out, prices[1][at], prices[0][at]))
        level = np.ceil(np.log2(followers + 1)).astype(np.int64)
        flat = (level << 1 | yes).astype(np.uint8)
        starts = np.cumsum(lengths) - lengths
        base = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
        sizes = np.array(pc.binary_length(texts)).astype(np.int64) + 1
        blobs = [flat[x : x + n].tobytes() for x, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        columns = [left.column("doc_id"), left.column("held_out"), lengths, np.add.reduceat((c[at] > 0).astype(np.int64), starts), np.add.reduceat(base[at], starts), np.add.reduceat(rest, starts), sizes, blobs]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(columns, FEATURE_KINDS, strict=True)], names=[c.split()[0] for c in FEATURES.split(", ")])

    features = written(grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(judge, FEATURES), "features")
    tables, pair_mixer = pair_model(features, tokens)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n = np.array(column_of(batch, "n_tokens"))
            scores = np.array(column_of(batch, "rest"))
            for x, y in slices(n, 1 << 20):
                bit, level, lengths = _decisions(column_of(batch, "pairs").slice(x, y - x).to_pylist())
                at, gate = pair_contexts(bit, level, lengths)
                without = np.repeat(~np.array(column_of(batch, "held_out"))[x:y], lengths).astype(np.int32)
                price = pair_mixer.log10(pair_inputs(tables, at, bit, without), gate, gate, bit)
                scores[x:y] += np.add.reduceat(price, np.cumsum(lengths) - lengths)
            sizes = np.array(column_of(batch, "n_bytes"))
            names = ("doc_id", "held_out", "n_tokens", "n_known", "base_score")
            d, h, t, k, s = (column_of(batch, c) for c in names)
            columns = [d, h, t, k, pa.array(np.full(len(n), tokens)), s, pa.array(scores), column_of(batch, "n_bytes"), pa.array(-scores * math.log2(10) / sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return features.mapInArrow(finish, SCHEMA)


#: What of the key of a pair of words is sent to its bucket. Of the pairs of a bucket, which are of the order of 2**20
#: whatever the corpus, about one in a million so shares its count with another.
PAIR_BITS = np.uint64((1 << 40) - 1)


def _pair_places(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair, and below it the bits that are sent."""
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64) << 40 | (keys & PAIR_BITS).astype(np.int64)


def _pairs_cut(places: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """As _cut, of distinct pair places: each bucket's in the order of the bits that are sent."""
    order = np.argsort(places)
    cuts = np.flatnonzero(np.diff(places[order] >> 40, prepend=-1))
    return [(int(places[own[0]] >> 40), own) for own in np.split(order, cuts[1:])] if len(places) else []


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    s = np.sort(values)
    starts = np.flatnonzero(np.diff(s, prepend=s[0] - 1)) if len(s) else np.zeros(0, dtype=np.int64)
    return s[starts], np.diff(np.append(starts, len(s)))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and which of them each key is."""
    import pandas as pd

    codes, found = pd.factorize(keys)
    return found, codes


def _sorted_distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, codes = _distinct(keys)
    order = np.argsort(found)
    place = np.empty(len(found), dtype=np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[codes]


FEATURE_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary())
