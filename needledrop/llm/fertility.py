"""Quality rules from tokeniser fertility: what public vocabularies make of a text."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import ENTRY_BYTES, bounded_batches, column_of, held, slices, texts_of, vocabulary_file

# Rejection bands. For a language: least and most characters per byte-level token, most share of byte
# fallback among pieces. Any other language goes by the script of most of its letters; a script without a band is "other".
BANDS = {
    "de": (1.45, 8.0, 0.10),
    "en": (1.45, 8.0, 0.10),
    "es": (1.35, 8.0, 0.10),
    "fr": (1.35, 8.0, 0.10),
    "latin": (1.10, 8.0, 0.20),
    "greek": (0.35, 8.0, 0.90),
    "cyrillic": (0.40, 8.0, 0.60),
    "hebrew": (0.35, 8.0, 0.90),
    "arabic": (0.35, 8.0, 0.90),
    "indic": (0.20, 8.0, 0.95),
    "kana": (0.30, 8.0, 0.90),
    "hangul": (0.25, 8.0, 0.95),
    "han": (0.25, 8.0, 0.95),
    "other": (0.20, 8.0, 0.90),
}
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "hangul", "han", "other")
# From which code point on letters belong to which script, in Unicode's order of blocks.
BLOCKS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"),
    (0x0E00, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB07, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x32000, "other"),
)


def script_of(text: str) -> str:
    """The script of most letters of the text; a tie goes to the first of SCRIPTS, a text without letters is latin."""
    if text.isascii():
        return "latin"
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), dtype="<u4")
    block = np.searchsorted(np.array([a for a, _ in BLOCKS]), points, side="right") - 1
    return SCRIPTS[np.bincount(np.array([SCRIPTS.index(n) for _, n in BLOCKS])[block], minlength=len(SCRIPTS)).argmax()]


# The least token entropy (bits) of running prose, at these logarithms (base 2) of the number of pieces.
# Between two of them the line; texts of fewer pieces than the first aren't judged by entropy.
ENTROPY_AT = (4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0)
ENTROPY_LEAST = (3.10, 4.10, 4.90, 5.45, 5.75, 6.00, 6.22, 6.32)

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


class Fertility:
    """What each word costs in both vocabularies, kept for words met before; emptied before words and pieces pass most_bytes, but for those of one batch.

    A word's tokens lie between tokens and tokens_most, which are equal once count() has met it. Before, the least is one, and
    the most follows from the vocabulary's merges: of n bytes (with the space before the word), m neighbouring pairs of which
    merge, no two that merge stay single, so that there are n - m / 3 tokens at most. Only ASCII letters count for m, as no
    pre-token ends between two of them where there is no apostrophe.
    """

    def __init__(self, byte_level: str, pieces: str, most_bytes: int = 56 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(vocabulary_file(byte_level))
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(pieces))
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        with open(vocabulary_file(byte_level), encoding="utf-8") as file:
            spec = json.load(file)
        self.pairs = np.zeros((256, 256), dtype=bool)
        if not any(t["content"].isalpha() for t in spec.get("added_tokens", [])):
            for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
                if len(a) == len(b) == 1 and b.isascii() and b.isalpha() and (a == "\u0120" or a.isascii() and a.isalpha()):
                    self.pairs[ord(" " if a == "\u0120" else a), ord(b)] = True
        self.most = most_bytes
        self.kind = np.uint16 if len(self.fallback) <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        self.size = 0
        self.tokens = self.tokens_most = self.sizes = self.bytes_in = np.zeros(0, dtype=np.int64)
        self.starts, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.kind)

    def learn(self, new: list[str]) -> None:
        ids = self.pieces.encode(new, num_threads=1)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=int(sizes.sum()))
        ends = np.cumsum(sizes)
        in_bytes = np.diff(np.concatenate(([0], np.cumsum(self.fallback[flat])))[np.concatenate(([0], ends))])
        letters = np.frombuffer(("".join(" " + w for w in new) + " ").encode(), dtype=np.uint8)
        lengths = np.asarray(pc.binary_length(pa.array(new, pa.large_string())), dtype=np.int64) + 1
        begin = np.cumsum(lengths) - lengths
        merging = np.add.reduceat(self.pairs[letters[:-1], letters[1:]].astype(np.int64), begin)
        merging[np.add.reduceat(letters[:-1] == ord("'"), begin, dtype=np.int64) > 0] = 0
        self.known.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.words += new
        self.tokens, self.tokens_most = np.concatenate((self.tokens, np.ones_like(lengths))), np.concatenate((self.tokens_most, lengths - (merging + 2) // 3))
        self.sizes, self.bytes_in = np.concatenate((self.sizes, sizes)), np.concatenate((self.bytes_in, in_bytes))
        self.starts = np.concatenate((self.starts, ends - sizes + len(self.flat)))
        self.flat = np.concatenate((self.flat, flat))

    def count(self, numbers: np.ndarray) -> None:
        """Counts the tokens of those of the words whose number of tokens isn't known yet."""
        new = np.unique(numbers[self.tokens[numbers] < self.tokens_most[numbers]])
        if len(new):
            encoded = self.byte_level.encode_batch_fast([" " + self.words[i] for i in new.tolist()], add_special_tokens=False)
            self.tokens[new] = self.tokens_most[new] = [len(e) for e in encoded]

    @staticmethod
    def cost(words: list[str]) -> int:
        """Bytes of words with their pieces (at most one a byte), and of what stands beside each."""
        return 5 * len("".join(words).encode()) + ENTRY_BYTES * len(words)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The numbers of the words of all texts, one after another, and where those of each text begin, and the end.

        Arrow cuts the texts and numbers their words, so that Python meets each distinct one once.
        """
        rows = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        met = rows.flatten().dictionary_encode()
        distinct = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.asarray(met.indices)
        real = at != (distinct.index("") if "" in distinct else -1)  # white space at an end of a text leaves an empty word there
        words = [w for w in distinct if w]
        found = list(map(self.known.get, words))
        new = [w for w, i in zip(words, found, strict=True) if i is None]
        if new:
            if self.size + self.cost(new) > self.most:
                self.clear()
                new = words
            self.size += self.cost(new)
            self.learn(new)
            found = list(map(self.known.__getitem__, words))
        number = np.zeros(len(distinct), dtype=np.int64)
        number[[i for i, w in enumerate(distinct) if w]] = found
        ends = np.concatenate(([0], np.cumsum(real)))
        return number[at[real]], ends[np.asarray(rows.offsets)].tolist()

    def entropy(self, words: np.ndarray) -> tuple[int, float]:
        """Pieces of the words, and the entropy of these in bits."""
        n = self.sizes[words]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return 0, 0.0
        flat = self.flat[np.repeat(self.starts[words] - ends + n, n) + np.arange(total)]
        counts = np.bincount(flat)
        counts = counts[counts > 0]
        return total, math.log2(total) - float((counts * np.log2(counts)).sum()) / total


def repeat_words(numbers: np.ndarray, window: int = 3) -> int:
    """Words that lie in a window of that many words which is found twice or more in the text."""
    if len(numbers) <= window:
        return 0
    keys = numbers.astype(np.uint64)
    size = most = int(numbers.max()) + 1
    for k in range(1, window):
        if most * size >= 1 << 64:  # numbered anew, the window so far has fewer values than the text has words
            keys = np.unique(keys, return_inverse=True)[1].astype(np.uint64)
            most = int(keys.max()) + 1
        keys = keys[:-1] * np.uint64(size) + numbers[k:].astype(np.uint64)
        most *= size
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    covered = np.zeros(len(numbers) + 1, dtype=np.int64)
    covered[twice] += 1
    covered[twice + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, n_pieces long, chars_per_token double, fallback_share double, token_entropy double"
)


def measure(docs: DataFrame, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model", batch_bytes: int = 2 << 20) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang), without a shuffle: counts, fertility and verdict.

    Words are runs of anything but ASCII white space. n_tokens: tokens of the words, each with a space before it, in the
    byte-level vocabulary; n_pieces: pieces of the words in the vocabulary with byte fallback; fallback_share: byte
    pieces among these; token_entropy: of the pieces of this text. A text is rejected when characters per token or the
    fallback share leave the band of its language or script (see BANDS, script_of), or, in Latin letters, the entropy is below that of prose of as many pieces
    (repetition, lists and signs between words have less); and when the base rules fail (under 50 words, or over
    half of the words in repeated three-word windows).

    Null or empty text: no words, base_failed. Null or unknown lang: the band of the script. Null ids stay null;
    repeated rows each give a row; an empty table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = held(("fertility", byte_level, pieces), lambda: Fertility(byte_level, pieces))
        for batch in batches:
            texts, langs = texts_of(batch), column_of(batch, "lang").to_pylist()
            sizes = np.array(pc.binary_length(column_of(batch, "text")), dtype=np.int64)
            out = []
            for a, b in slices(sizes, batch_bytes):
                flat, ends = store.numbers(texts[a:b])
                store.count(flat)
                out += [judge(store, text, lang, flat[x:y]) for text, lang, x, y in zip(texts[a:b], langs[a:b], ends[:-1], ends[1:], strict=True)]
            columns = [*zip(*out, strict=True)] or [()] * 12
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lower(F.col("lang").cast("string")).alias("lang"))
    return rows.mapInArrow(run, SCHEMA)


def length(text: str) -> int:
    """Characters of the text's words."""
    return len(text) - sum(map(text.count, SPACES))


def band(text: str, lang: str | None) -> str:
    """The name of the text's band."""
    return script_of(text) if lang not in BANDS or lang in SCRIPTS else lang


def like_prose(lang: str, n_pieces: int, entropy: float) -> bool:
    """Whether the pieces of a text of a band have the entropy of prose, or aren't judged by it."""
    if n_pieces >= 2 ** ENTROPY_AT[0] and (lang == "latin" or lang not in SCRIPTS):
        return entropy >= float(np.interp(math.log2(n_pieces), ENTROPY_AT, ENTROPY_LEAST))
    return True


def judge(store: Fertility, text: str, lang: str | None, numbers: np.ndarray) -> tuple:
    n = len(numbers)
    chars = length(text)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = repeat_words(numbers)
    failed = n < 50 or 100 * repeats > 50 * n
    tokens = int(store.tokens[numbers].sum())
    n_pieces, entropy = store.entropy(numbers)
    fallback = float(store.bytes_in[numbers].sum()) / n_pieces if n_pieces else 0.0
    per_token = chars / tokens if tokens else 0.0
    lang = band(text, lang)
    low, high, most = BANDS[lang]
    good = low <= per_token <= high and fallback <= most and like_prose(lang, n_pieces, entropy)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, bool(good and not failed), tokens, n_pieces, per_token, fallback, entropy


def keeps(store: Fertility, text: str, lang: str | None, numbers: np.ndarray) -> bool:
    """The verdict of judge(), by the rule that is cheapest first.

    Words whose tokens aren't counted yet have bounds; they are counted where a text could be in its band by one bound and
    outside it by the other, so the verdict is exact.
    """
    n = len(numbers)
    if n < 50 or 100 * repeat_words(numbers) > 50 * n:
        return False
    lang = band(text, lang)
    low, high, most = BANDS[lang]
    n_pieces, entropy = store.entropy(numbers)
    if (float(store.bytes_in[numbers].sum()) / n_pieces if n_pieces else 0.0) > most or not like_prose(lang, n_pieces, entropy):
        return False
    chars = length(text)
    per_token = lambda: (chars / int(store.tokens_most[numbers].sum()), chars / int(store.tokens[numbers].sum()))
    least, largest = per_token()
    if largest < low or least > high:
        return False
    if least < low or largest > high:
        store.count(numbers)
        least, largest = per_token()
    return low <= least and largest <= high


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that measure() keeps; decided row by row, without a shuffle or a join."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = held(("fertility", "byte_bpe_50k.json", "piece_bpe_32k.model"), lambda: Fertility("byte_bpe_50k.json", "piece_bpe_32k.model"))
        for batch in batches:
            texts = [t or "" for t in texts_of(batch)]
            langs = [x and x.lower() for x in column_of(batch, "lang").to_pylist()]
            keep = np.zeros(len(texts), dtype=bool)
            for a, b in slices(np.array([len(t) for t in texts], dtype=np.int64), 2 << 20):
                flat, ends = store.numbers(texts[a:b])
                keep[a:b] = [keeps(store, text, lang, flat[x:y]) for text, lang, x, y in zip(texts[a:b], langs[a:b], ends[:-1], ends[1:], strict=True)]
            yield batch.filter(pa.array(keep))

    return bounded_batches(docs).select(*names).mapInArrow(run, schema)
