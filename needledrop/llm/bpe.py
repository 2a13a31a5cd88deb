"""BPE encoding by a pair occurrence index, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from needledrop.llm.common import Store, column_of, held, slices, texts_of, vocabulary_file, with_ids
from needledrop.llm.encoding import chunks, pieces


#: Fixed value: the public pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Latin letters and signs but the one that begins special tokens, after one space at most.
PLAIN = re.compile("(?: ?[!-;=-~\u00a1-\u024f]+)")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndexBpe:
    """A byte-level BPE vocabulary whose merges run over a whole batch of words at once.

    The distinct new words of a batch lie one after another in one array of symbols. Each pair that has a rank maps to all
    its positions; active ranks come from a heap in ascending order, all positions of a rank are merged from left to
    right, and the two pairs that a merge makes at its sides join their lists. A position whose pair has gone
    meanwhile is passed over. Ranks with many positions are merged as arrays, the others one position at a time.
    Chunks keep their ids in a store of at most most_bytes bytes.
    """

    #: From so many positions a rank is merged as arrays.
    MANY = 24

    def __init__(self, vocabulary: str, most_bytes: int = 96 << 20):
        import regex
        from tokenizers import pre_tokenizers

        with open(vocabulary_file(vocabulary), encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        self.first = np.zeros(0x200, dtype=np.int64)
        for c in byte_alphabet():
            self.first[ord(c)] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        self.rank = {(a << 20) | b: r for r, (a, b, _) in reversed([*enumerate(self.merges)])}
        self.keys = np.array(sorted(self.rank), dtype=np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.easy = all(t[0] == "<" for t in self.special)
        self.pattern = regex.compile(PATTERN)
        self.letters = {i: c for i, c in enumerate(byte_alphabet())}
        self.words_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.store = Store(most_bytes)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word (a string over the byte alphabet) as little-endian 32-bit integers."""
        text = "".join(words)
        n = len(text)
        if not n:
            return [b""] * len(words)
        symbols = self.first[np.frombuffer(text.encode("utf-16-le"), dtype="<u2")]
        ends = np.cumsum([len(w) for w in words])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate(([0], ends[:-1]))[np.diff(ends, prepend=0) > 0]] = -1
        pairs = np.flatnonzero(after >= 0)
        ranks = self.ranks_of(symbols[pairs], symbols[pairs + 1])
        pairs, ranks = pairs[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        pairs, ranks = pairs[order], ranks[order]
        cuts = [*np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))).tolist(), len(ranks)] if len(ranks) else [0]
        #: rank: its positions, as arrays and as a list of single ones.
        places = {int(ranks[x]): ([pairs[x:y]], []) for x, y in zip(cuts[:-1], cuts[1:], strict=True)}
        active = [*places]
        heapify(active)
        s, a_, b_ = memoryview(symbols), memoryview(after), memoryview(before)
        rank_of, merges = self.rank, self.merges

        def one(rank: int, at: int) -> None:
            found = places.get(rank)
            if found is None:
                places[rank] = ([], [at])
                heappush(active, rank)
            else:
                found[1].append(at)

        def many(rank: np.ndarray, at: np.ndarray) -> None:
            good = rank >= 0
            rank, at = rank[good], at[good]
            if len(rank) <= self.MANY:
                for r, i in zip(rank.tolist(), at.tolist(), strict=True):
                    one(r, i)
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = [*np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))).tolist(), len(rank)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                r = int(rank[x])
                if r not in places:
                    places[r] = ([], [])
                    heappush(active, r)
                places[r][0].append(at[x:y])

        while active:
            r = heappop(active)
            left, right, new = merges[r]
            arrays, single = places.pop(r)
            size = sum(map(len, arrays)) + len(single)
            if size > self.MANY and left != right:
                i = np.unique(np.concatenate([*arrays, np.array(single, dtype=np.int64)]))
                j = after[i]
                good = (symbols[i] == left) & (j >= 0)
                good[good] = symbols[j[good]] == right
                i, j = i[good], j[good]
                k, h = after[j], before[i]
                symbols[i], symbols[j], after[i] = new, -1, k
                has = k >= 0
                before[k[has]] = i[has]
                many(self.ranks_of(np.full(int(has.sum()), new), symbols[k[has]]), i[has])
                # The left neighbour may have merged in this step as well: its symbol is read now.
                has = h >= 0
                many(self.ranks_of(symbols[h[has]], np.full(int(has.sum()), new)), h[has])
                continue
            for i in sorted([x for some in arrays for x in some.tolist()] + single):
                j = a_[i]
                if s[i] != left or j < 0 or s[j] != right:
                    continue
                k, h = a_[j], b_[i]
                s[i], s[j], a_[i] = new, -1, k
                if k >= 0:
                    b_[k] = i
                    if (x := rank_of.get((new << 20) | s[k])) is not None:
                        one(x, i)
                if h >= 0 and (x := rank_of.get((s[h] << 20) | new)) is not None:
                    one(x, h)
        left_over = symbols >= 0
        data = symbols[left_over].astype("<i4").tobytes()
        stops = (4 * np.concatenate(([0], np.cumsum(left_over)[ends - 1]))).tolist() if len(words) else [0]
        return [data[x:y] for x, y in zip(stops[:-1], stops[1:], strict=True)]

    def split(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a chunk; special tokens, which come first as in the library, as ids."""
        for token, number in self.special.items():
            if token in chunk:
                left, _, right = chunk.partition(token)
                return [*(self.split(left) if left else []), number, *(self.split(right) if right else [])]
        return [w for w, _ in self.words_of(chunk)]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each chunk, some hundred kilobytes of chunks at a time."""
        known = {"": b""}
        for a, b in slices(np.array([len(c) for c in new], dtype=np.int64), 1 << 18):
            some = new[a:b]
            plain = [c for c in some if PLAIN.fullmatch(c)] if self.easy else []
            others = [c for c in some if c and not PLAIN.fullmatch(c)] if self.easy else some
            known |= self._learn_plain(plain)
            parts = [self.split(c) for c in others]
            words = [*{w for p in parts for w in p if isinstance(w, str)}]
            ids: dict[str | int, bytes] = dict(zip(words, self.merge(words), strict=True))
            ids |= {n: np.array([n], dtype="<i4").tobytes() for n in self.special.values()}
            known.update((c, b"".join([ids[w] for w in p])) for c, p in zip(others, parts, strict=True))
        return known

    def _learn_plain(self, new: list[str]) -> dict[str, bytes]:
        """Chunks of Latin letters and signs, without white space inside: cut by one pass of the public pattern over all of
        them, one in a line, as a line feed is a pre-token of its own there."""
        if not new:
            return {}
        tokens = self.pattern.findall("\n".join(new))
        words = [*{*tokens} - {"\n"}]
        spelled = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        ids = dict(zip(words, self.merge(spelled), strict=True))
        # Chunks of one word are most of them.
        ids["\n"] = b""
        flat = list(map(ids.__getitem__, tokens))
        start, rows = 0, []
        for end in [*(i for i, t in enumerate(tokens) if t == "\n"), len(tokens)]:
            rows.append(flat[start] if end - start == 1 else b"".join(flat[start:end]))
            start = end + 1
        return dict(zip(new, rows, strict=True))

    def encode(self, parts: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian 32-bit integers."""
        return self.store.values(parts, self.learn)

    def texts(self, texts: list[str], most: int) -> list[bytes]:
        """The ids of each text: the chunks of all together, those of a text over `most` characters part by part."""
        long = {i: b"".join(x for part in pieces(t, most) for x in self.encode(chunks(part))) for i, t in enumerate(texts) if len(t) > most}
        rows = [[] if i in long else chunks(t) for i, t in enumerate(texts)]
        flat = self.encode([c for row in rows for c in row])
        out, at = [], 0
        for i, row in enumerate(rows):
            out.append(long[i] if i in long else b"".join(flat[at : at + len(row)]))
            at += len(row)
        return out


class Spelling:
    """Short strings by number, one after another in one array, so that those of many numbers are one gather."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(b) for b in spelled], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def __call__(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """What neighbouring runs of ids spell, run by run; ids outside the table spell nothing."""
        out = []
        starts = np.cumsum(lengths) - lengths
        for a, b in slices(lengths, 100_000):
            some = ids[starts[a] : starts[a] + lengths[a:b].sum()]
            known = (some >= 0) & (some < len(self.size))
            some = np.where(known, some, 0)
            n = np.where(known, self.size[some], 0)
            ends = np.cumsum(n)
            whole = self.letters[np.repeat(self.start[some] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths[a:b])))].tolist()
            out += [whole[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        return out


def spelling(vocabulary: str) -> Spelling:
    """The bytes of every id of a byte-level BPE file."""
    with open(vocabulary_file(vocabulary), encoding="utf-8") as file:
        spec = json.load(file)
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    plain = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special} | special
    return Spelling([plain.get(i, b"") for i in range(max(plain) + 1)])


def _encoded(model: PairIndexBpe, batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """doc_ids and the ids of their texts, some of each batch at a time."""
    for batch in batches:
        texts, ids = texts_of(batch), column_of(batch, "doc_id")
        for a, b in slices(np.array([len(t) for t in texts], dtype=np.int64), batch_bytes):
            yield ids.slice(a, b - a), model.texts(texts[a:b], batch_bytes)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", batch_bytes: int = 3 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int> for every row of docs, without a shuffle.

    The ids are those of the tokenizers library for a byte-level BPE file, without added special tokens; the merges run
    here, by the pair occurrence index of PairIndexBpe over the new words of each batch of at most batch_bytes bytes.

    Null text: empty, no ids. Null ids stay null; repeated rows each give a row; an empty table gives no row; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("bpe", "model", vocabulary), lambda: PairIndexBpe(vocabulary))
        for ids, lists in _encoded(model, batches, batch_bytes):
            ends = np.cumsum([0, *(len(x) // 4 for x in lists)])
            values = pa.array(np.frombuffer(b"".join(lists), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"])

    return with_ids(docs, text, doc_id).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids, text for rows of doc_id, ids array<int>; special tokens are kept.

    Bytes that are no UTF-8 become U+FFFD. Null ids: null text and null n_tokens. Ids outside the vocabulary spell nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = held(("bpe", "spelling", vocabulary), lambda: spelling(vocabulary))
        for batch in batches:
            lists = column_of(batch, "ids")
            n_tokens = pa.compute.list_value_length(lists)
            lengths = np.array(pa.compute.fill_null(n_tokens, 0), dtype=np.int64)
            texts = [x.decode("utf-8", "replace") for x in spell(np.array(lists.flatten(), dtype=np.int64), lengths)]
            texts = pa.array(texts, pa.string(), mask=np.array(lists.is_null()))
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), n_tokens.cast(pa.int64()), lists, texts], names=["doc_id", "n_tokens", "ids", "text"])

    import pyarrow.compute  # noqa: F401

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", batch_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8 of the decoded text).

    The ids of encode() and the texts of decode(), in one pass: neither leaves the task. Rows as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("bpe", "model", vocabulary), lambda: PairIndexBpe(vocabulary))
        spell = held(("bpe", "spelling", vocabulary), lambda: spelling(vocabulary))
        decimal = held(("bpe", "decimals", len(spell.size)), lambda: Spelling([b"%d," % i for i in range(len(spell.size))]))
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for ids, lists in _encoded(model, batches, batch_bytes):
            lengths = np.array([len(x) // 4 for x in lists], dtype=np.int64)
            flat = np.frombuffer(b"".join(lists), dtype="<i4")
            of_ids = [digest(x[:-1]) for x in decimal(flat, lengths)]
            decoded = [digest(x.decode("utf-8", "replace").encode()) for x in spell(flat, lengths)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(of_ids, pa.string()), pa.array(decoded, pa.string())], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return with_ids(docs).mapInArrow(run, DIGESTS)
