"""Token counts of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from needledrop.llm.common import column_of, held, slices, texts_of, vocabulary_file, with_ids
from needledrop.llm.encoding import ChunkEncoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


#: A space between two ASCII letters or digits: no normaliser joins what is on its sides.
BETWEEN = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def _sentencepiece(vocabulary: str, batch_bytes: int):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(vocabulary))
    spelled = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    # A cut is safe if no piece goes on behind a space and each part gets its space back as a prefix.
    cuts = not any("\u2581" in p.lstrip("\u2581") for p in spelled) and model.encode("ab cd") == model.encode("ab") + model.encode("cd")

    def parts(text: str) -> list[str]:
        out, start = [], 0
        while cuts and len(text) - start > batch_bytes and (cut := BETWEEN.search(text, start + batch_bytes)):
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def count(texts: list[str]) -> list[int]:
        return [sum(len(ids) for part in parts(t) for ids in model.encode([part], num_threads=1)) if len(t) > batch_bytes else n for t, n in zip(texts, short(texts), strict=True)]

    def short(texts: list[str]) -> list[int]:
        return [len(ids) for ids in model.encode([t if len(t) <= batch_bytes else "" for t in texts], num_threads=1)]

    return count


def _byte_level(vocabulary: str, batch_bytes: int):
    encoder = ChunkEncoder(vocabulary)

    def count(texts: list[str]) -> list[int]:
        """Lengths only. The chunks of all texts of the batch go to the library together, each distinct one once."""
        rows, row_of = [], []
        for i, text in enumerate(texts):
            for part in encoder.pieces(text, batch_bytes):
                rows.append(encoder.chunks(part))
                row_of.append(i)
        counts = np.array(encoder.values([c for row in rows for c in row]), dtype=np.int64)
        ends = np.cumsum([len(row) for row in rows])
        sums = np.add.reduceat(counts, np.concatenate(([0], ends[:-1])))
        return np.bincount(row_of, weights=sums, minlength=len(texts)).astype(np.int64).tolist()

    return count


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, batch_bytes: int = 2 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of docs, without a shuffle.

    Tokens are those of the library for the vocabulary: tokenizers for a .json file, sentencepiece for a .model file;
    no begin, end or added special tokens, and no truncation. Arrow batches are dealt into batches of at most
    batch_bytes bytes; a longer text is cut at safe boundaries (see encoding; for sentencepiece a space between two ASCII
    letters or digits, if the vocabulary allows it). Only lengths return.

    Null text: empty, 0 tokens. Null ids stay null; repeated rows each give a row; an empty table gives no row; other
    columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held(("token counts", vocabulary, batch_bytes), lambda: _sentencepiece(vocabulary, batch_bytes) if vocabulary.endswith(".model") else _byte_level(vocabulary, batch_bytes))
        for batch in batches:
            texts = texts_of(batch)
            sizes = np.array(pa.compute.binary_length(column_of(batch, "text")), dtype=np.int64)
            tokens = np.zeros(len(texts), dtype=np.int64)
            for a, b in slices(sizes, batch_bytes):
                tokens[a:b] = count(texts[a:b])
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return with_ids(docs, text, doc_id).mapInArrow(run, SCHEMA)
