"""Byte-level BPE over whole texts through the tokenizers library, with each distinct chunk encoded once.

A text is cut where the byte-level pre-tokeniser cuts in any context: before a single space between two
characters that are no white space, and on both sides of a single line feed between two such characters. So the
tokens of the chunks, one after another, are the tokens of the text. Chunks met before come from a bounded store.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from needledrop.llm.common import Store, vocabulary_file

#: In a text without these no space or line feed has white space at its side: the plain cut is safe everywhere in it.
NEAR = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
#: A chunk without white space but one space before it.
WORD = re.compile(r" ?\S+")
SPACE = re.compile(r"(?<=\S) (?=\S)")
LINE = re.compile(r"(?<=\S)\n(?=\S)")
MARKS = "\x01\x02\x03\x04\x05\x06"


def marked(text: str, mark: str) -> str:
    """The text with a mark at every safe boundary."""
    if any(c in text for c in NEAR):
        return SPACE.sub(mark + " ", LINE.sub(f"{mark}\n{mark}", text))
    return text.replace(" ", mark + " ").replace("\n", f"{mark}\n{mark}")


def chunks(text: str) -> list[str]:
    """The text cut at every safe boundary; joined they are the text."""
    mark = next((m for m in MARKS if m not in text), None)
    return [text] if mark is None else marked(text, mark).split(mark)


def pieces(text: str, most: int) -> Iterator[str]:
    """Parts of a long text, each over `most` characters, cut at safe boundaries; a part ends later where none is near."""
    start = 0
    while len(text) - start > most:
        cut = SPACE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class ChunkEncoder:
    """The library's tokens of each chunk: how many (kind None), or their ids as bytes of an integer kind.

    Chunks met before come from a store of at most most_bytes bytes. New ones go to the library some hundreds together, one in a
    line, as a line feed between them is a token of its own; a chunk with white space inside goes alone. Vocabularies that
    are not byte-level without a prefix space, or that normalise, get whole texts instead of chunks.
    """

    def __init__(self, vocabulary: str, kind: str | None = None, most_bytes: int = 180 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_file(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.cuts and len(line) == 1 else None
        self.kind, self.store = kind, Store(most_bytes)

    def chunks(self, text: str) -> list[str]:
        return chunks(text) if self.cuts else [text]

    def pieces(self, text: str, most: int) -> Iterator[str]:
        return pieces(text, most) if self.cuts else iter([text])

    def value(self, ids) -> int | bytes:
        return len(ids) if self.kind is None else np.asarray(ids, dtype=self.kind).tobytes()

    def learn(self, new: list[str]) -> dict[str, int | bytes]:
        known, encode = {}, self.library.encode_batch_fast
        plain, others = [], []
        for c in new:
            (plain if self.line is not None and WORD.fullmatch(c) else others).append(c)
        for at in range(0, len(plain), 25_600):
            groups = [plain[i : i + 256] for i in range(at, min(at + 25_600, len(plain)), 256)]
            for group, e in zip(groups, encode(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.kind or "<u4")
                ends = np.append(np.flatnonzero(ids == self.line), len(ids))
                if len(ends) != len(group):
                    others += group
                elif self.kind is None:
                    known.update(zip(group, np.diff(ends, prepend=-1).__sub__(1).tolist(), strict=True))
                else:
                    width, data = ids.itemsize, ids.tobytes()
                    stops = (ends * width).tolist()
                    known.update((c, data[a:b]) for c, a, b in zip(group, [0, *(x + width for x in stops[:-1])], stops, strict=True))
        for at in range(0, len(others), 5_000):
            some = others[at : at + 5_000]
            known.update((c, self.value(e.ids)) for c, e in zip(some, encode(some, add_special_tokens=False), strict=True))
        return known

    def values(self, parts: list[str]) -> list:
        return self.store.values(parts, self.learn)

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes. Arrow cuts the texts and numbers their chunks, so that Python meets each distinct one once."""
        mark = next((m for m in MARKS if not any(m in t for t in texts)), None) if self.cuts else None
        if mark is None:
            rows = pa.array([self.chunks(t) for t in texts], pa.list_(pa.large_string()))
        else:
            rows = pc.split_pattern(pa.array([marked(t, mark) for t in texts], pa.large_string()), pattern=mark)
        met = rows.flatten().dictionary_encode()
        distinct = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self.values(distinct), pa.large_binary()).take(met.indices)
        ends = np.cumsum(np.asarray(pc.binary_length(ids)))
        stops = np.append(0, ends)[np.asarray(rows.offsets)].tolist()
        data = ids.buffers()[2].to_pybytes() if stops[-1] else b""
        return [data[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
