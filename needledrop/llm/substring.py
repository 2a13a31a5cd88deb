"""Substring dedup by fixed-block anchors: long passages that an earlier document holds are taken out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import NULL_ID, WordHashes, bounded_batches, column_of, give_back, held, mix, pack, pack_sorted, partitions_for, texts_of, unpack, unpack_sorted, with_ids

#: Odd multipliers of the rolling sums (any odd number gives a bijection; these are 5 modulo 8).
BASE_A, BASE_B = 0x9E3779B97F4A7C1D, 0xD1342543DE82EF9D
#: Words whose windows are handled at a time in a task.
WORDS = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n at least, modulo 2**64; kept in the process, and made anew when too short."""
    kept = held(("substring", "powers", base), dict)
    if len(kept.get("all", ())) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, dtype=np.uint64)
        steps[0] = 1
        kept["all"] = np.multiply.accumulate(steps)
    return kept["all"]


def window_hashes(words: np.ndarray, size: int, base: int = BASE_A) -> np.ndarray:
    """A 64-bit hash of every run of `size` neighbouring word hashes: sums of words times powers, modulo 2**64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up = _powers(base, len(words) + 1)
    down = _powers(pow(base, -1, 2**64), len(words) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    return mix((sums[size:] - sums[:-size]) * down[:n])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return held(("substring", "words"), lambda: WordHashes(8))(words)


def _streams(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """Documents of about WORDS words together: their words' hashes, then the columns' values."""
    rows, total = [], 0
    for batch in batches:
        others = [column_of(batch, c).to_pylist() for c in columns]
        for text, *rest in zip(texts_of(batch), *others, strict=True):
            words = text.encode().split()
            rows.append((word_hashes(words), *rest))
            total += len(words)
            if total >= WORDS:
                yield tuple(map(list, zip(*rows, strict=True)))
                rows, total = [], 0
    if rows:
        yield tuple(map(list, zip(*rows, strict=True)))


def _windows(words: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows inside documents: hash, number of the document, place in it."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
    hashes = window_hashes(flat, size)
    n = np.maximum(lengths - size + 1, 0)
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(words)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return hashes[starts[doc] + place], doc, place


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def _batch(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns], names=names)


BUCKETS = "bucket int, blob binary, refs binary, places binary"
#: Hits on their way to documents: many documents' ids and values together, by a bucket of documents.
SENT = "to int, ids binary, values binary"
HITS = "hit_id long, hits binary"
COLUMNS = ["bucket", "blob", "refs", "places", "to", "ids", "values"]


def _sent(ids: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Hits for each bucket of documents: sorted ids, and the values in that order."""
    ids = ids.astype(np.int64).view(np.uint64)
    to = (mix(ids) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids, to))
    ids, values, to = ids[order], values[order], to[order]
    cuts = [*_groups(to).tolist(), len(to)]
    runs = [*zip(cuts[:-1], cuts[1:], strict=True)]
    return _batch(["to", "ids", "values"], pa.array(to[cuts[:-1]], pa.int32()), pa.array([pack_sorted(ids[x:y]) for x, y in runs], pa.binary()), pa.array([pack(values[x:y]) for x, y in runs], pa.binary()))


def _by_document(sent: DataFrame, buckets: int, kind: str) -> DataFrame:
    """hit_id, hits: one row for each document with its distinct values."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        ids, values = [], []
        for batch in batches:
            ids += map(unpack_sorted, column_of(batch, "ids").to_pylist())
            values += (unpack(x, kind) for x in column_of(batch, "values").to_pylist())
        if not ids:
            return
        d, v = np.concatenate(ids), np.concatenate(values)
        order = np.lexsort((v, d))
        d, v = d[order], v[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])))
        d, v = d[new], v[new]
        first = _groups(d)
        cuts = np.append(first, len(d)).tolist()
        for at in range(0, len(first), 5_000):
            some = cuts[at : at + 5_001]
            yield _batch(["hit_id", "hits"], pa.array(d[some[:-1]].view(np.int64)), pa.array([pack(v[x:y]) for x, y in zip(some[:-1], some[1:], strict=True)], pa.binary()))

    return sent.repartition(buckets, "to").mapInArrow(gather, HITS)


def anchors(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """hit_id, hits (packed 32-bit integers): for each document the places of block-long windows that share their words with another's block.

    Index: the blocks at every multiple of `block` words. Probes: every rolling window. Both go to the bucket of their
    hash; what meets there from two documents, at least one of them as a block, is a hit of all that hold it. Windows that
    several documents of one task share are hits at once, and two of them stand for all in the shuffle: a passage that
    a third of all documents hold sends two entries for each task, not one for each document. A window that one document
    of a stream holds several times is sent at its first place in each row: candidates() finds its other places again.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids in _streams(batches, "doc_id"):
            ids = np.array(ids, dtype=np.int64)
            h, doc, place = _windows(words, block)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")  # within a hash by document, then place
            s, d = h[order], ids[doc[order]]
            first = _groups(s)
            n = np.diff(np.append(first, len(s)))
            # The first of each group, and the first of another document in it.
            changed = np.concatenate(([False], (s[1:] == s[:-1]) & (d[1:] != d[:-1])))
            group = np.repeat(np.arange(len(first)), n)
            shared = np.zeros(len(first), dtype=bool)
            shared[group[changed]] = True
            local = shared[group]
            if local.any():
                yield _tagged(_sent(d[local], place[order][local].astype("<u4"), buckets))
            second = np.flatnonzero(changed)
            second = second[_groups(group[second])]
            aligned = np.zeros(len(first), dtype=bool)
            aligned[group[place[order] % block == 0]] = True
            # Rows of equal id have their places in common, but each its own: the first of every further row goes too.
            row = doc[order]
            further = np.flatnonzero(np.concatenate(([False], (s[1:] == s[:-1]) & (row[1:] != row[:-1]))) & ~local)
            send = np.concatenate((first, second, further))
            keep = np.sort(order[send])
            sent_group = np.empty(len(h), dtype=np.int64)
            sent_group[order] = group
            flag = aligned[sent_group[keep]]
            b = (h[keep] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            keep, flag, b = keep[by], flag[by], b[by]
            rest = (h[keep] // np.uint64(buckets)).astype("<u4")
            did, where = ids[doc[keep]], place[keep]
            where = (where.astype(np.uint32) << np.uint32(1)) | flag.astype(np.uint32)
            cuts = [*_groups(b).tolist(), len(b)]
            blobs, refs, places = [], [], []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                blobs.append(rest[x:y].tobytes())
                refs.append(pack(np.diff(did[x:y], prepend=0).view(np.uint8).reshape(-1, 8).T))
                places.append(pack(np.diff(where[x:y].astype(np.int64), prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T))
            yield _batch(COLUMNS, pa.array(b[cuts[:-1]], pa.int32()), *(pa.array(x, pa.binary()) for x in (blobs, refs, places)), *_nothing(len(blobs)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        passed: list[pa.RecordBatch] = []
        for columns in _buckets(batches, passed):
            h = np.concatenate([np.frombuffer(x, "<u4") for x in columns["blob"]])
            ids = np.concatenate([np.cumsum(np.ascontiguousarray(unpack(x, "u1").reshape(8, -1).T).view("<i8").ravel()) for x in columns["refs"]])
            where = np.concatenate([np.cumsum(np.ascontiguousarray(unpack(x, "u1").reshape(4, -1).T).view("<i4").ravel().astype(np.int64)) for x in columns["places"]])
            order = np.argsort(h, kind="stable")
            s, d, w = h[order], ids[order], where[order]
            first = _groups(s)
            block_there = np.bitwise_or.reduceat(w & 1, first) if len(first) else w
            two = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(first) else d
            hit = np.repeat((block_there == 1) & two, np.diff(np.append(first, len(s))))
            if hit.any():
                yield _sent(d[hit], (w[hit] >> 1).astype("<u4"), buckets)
        yield from passed

    # Hits found in a task pass through by their bucket of documents.
    probes = docs.mapInArrow(probe, f"{BUCKETS}, {SENT}").withColumn("bucket", F.coalesce("bucket", "to"))
    return _by_document(probes.repartition(buckets, "bucket").mapInArrow(meet, SENT), buckets, "<u4")


def _nothing(n: int) -> list[pa.Array]:
    return [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]


def _tagged(rows: pa.RecordBatch) -> pa.RecordBatch:
    n = len(rows)
    return _batch(COLUMNS, pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(3)), *rows.columns)


def _buckets(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """A bucket's blobs together, bucket by bucket; rows that only pass through go to passed."""
    names = ("blob", "refs", "places")
    found: dict[int, dict[str, list]] = {}
    for batch in batches:
        columns = [column_of(batch, n).to_pylist() for n in ("bucket", *names)]
        through = []
        for bucket, *blobs in zip(*columns, strict=True):
            through.append(blobs[0] is None)
            if blobs[0] is not None:
                mine = found.setdefault(bucket, {n: [] for n in names})
                for n, x in zip(names, blobs, strict=True):
                    mine[n].append(x)
        if any(through):
            passed.append(batch.filter(pa.array(through)).select(["to", "ids", "values"]))
    for bucket in [*found]:
        yield found.pop(bucket)


def confirmed(marked: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """hit_id, hits (packed 64-bit integers): for each document the hashes of its windows that a document with a smaller id holds too.

    Every hit is extended: each window of `window` words around it is looked up by its own hash (two rolling sums in 64
    bits). The smallest id that holds a window is found within the task, then among tasks; only one entry for each
    task and window is shuffled.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids, hits in _streams(batches, "doc_id", "hits"):
            ids = np.array(ids, dtype=np.int64)
            some = candidates(words, hits, window, block)
            h, d = some[0], ids[some[1]]
            if not len(h):
                continue
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = _groups(h)
            least = np.repeat(d[first], np.diff(np.append(first, len(h))))
            later = d > least
            if later.any():
                yield _tagged(_sent(d[later], h[later], buckets))
            h, d = h[first], d[first]
            b = (h % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")  # within a bucket by hash
            h, d, b = h[by], d[by], b[by]
            cuts = [*_groups(b).tolist(), len(b)]
            blobs = [pack_sorted(h[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            table = [np.unique(d[x:y], return_inverse=True) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            refs = [pack_sorted(t) for t, _ in table]
            places = [pack(i.astype("<u4")) for _, i in table]
            yield _batch(COLUMNS, pa.array(b[cuts[:-1]], pa.int32()), *(pa.array(x, pa.binary()) for x in (blobs, refs, places)), *_nothing(len(blobs)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        passed: list[pa.RecordBatch] = []
        for columns in _buckets(batches, passed):
            h = np.concatenate([unpack_sorted(x) for x in columns["blob"]])
            d = np.concatenate([unpack_sorted(t).view(np.int64)[unpack(i, "<u4")] for t, i in zip(columns["refs"], columns["places"], strict=True)])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = _groups(h)
            later = d > np.repeat(d[first], np.diff(np.append(first, len(h))))
            if later.any():
                yield _sent(d[later], h[later], buckets)
        yield from passed

    found = marked.mapInArrow(extend, f"{BUCKETS}, {SENT}").withColumn("bucket", F.coalesce("bucket", "to"))
    return _by_document(found.repartition(buckets, "bucket").mapInArrow(meet, SENT), buckets, "<u8")


def candidates(words: list[np.ndarray], hits: list[bytes | None], window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that hold a hit or the words of one: hash, number of the document, place in it.

    A hit stands for every place of its block-long window in the document, as only the first may have been sent.
    """
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    mark = np.zeros(int(lengths.sum()) + 1, dtype=np.int64)
    reach = window - block
    for start, n, blob, mine in zip(starts.tolist(), lengths.tolist(), hits, words, strict=True):
        if n < window or blob is None:
            continue
        p = unpack(blob, "<u4").astype(np.int64)
        p = p[p <= n - block]
        if len(p) <= n - block:
            blocks = window_hashes(mine, block)
            p = np.flatnonzero(np.isin(blocks, blocks[p]))
        low, high = np.maximum(p - reach, 0), np.minimum(p, n - window) + 1
        np.add.at(mark, start + low[low < high], 1)
        np.add.at(mark, start + high[low < high], -1)
    at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    flat = np.concatenate(words)
    a, b = window_hashes(flat, window), window_hashes(flat, window, BASE_B)
    doc = np.searchsorted(starts + lengths, at, side="right")
    return a[at] ^ (b[at] << np.uint64(1) | b[at] >> np.uint64(63)), doc, at - starts[doc]


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space), then the columns carry, for every row.

    A word goes when it lies in a window of `window` words of its document whose words also start in a document with a
    smaller id. Blocks have half a window, so every window of the earlier document holds a whole block; hits on
    blocks are extended to the maximal exact repeats, which are the runs of confirmed windows (see anchors and
    confirmed). All windows are judged on the input. Words compare by 64-bit hashes.

    With verbatim, kept is the text itself where nothing goes.

    Null text: no words, kept is empty. A null id counts as larger than every other; rows with equal ids never remove
    each other's words. An empty table gives no row. Columns that aren't named are ignored, whatever their names.
    """
    block = window // 2
    buckets = partitions_for(docs)
    own = [f"_{i}" for i in range(len(carry))]
    rows = bounded_batches(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("_id"), *(F.col(c).alias(n) for n, c in zip(own, carry, strict=True)))
    hits = anchors(rows.select("doc_id", "text").where("text <> ''"), block, buckets)
    # The texts are dealt by id once, with all columns: both uses of the join read that exchange.
    marked = rows.join(hits, rows["doc_id"] == hits["hit_id"], "left").select("doc_id", "text", "hits", "_id", *own)
    repeats = confirmed(marked.where("hits is not null"), window, block, buckets).withColumnRenamed("hits", "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, hits, known in zip(*(column_of(batch, c).to_pylist() for c in ("_id", "text", "hits", "repeats")), strict=True):
                words = t.encode().split()
                n = len(words)
                gone = 0
                if known and n >= window:
                    h, _, place = candidates([word_hashes(words)], [hits], window, block)
                    bad = place[np.isin(h, unpack(known, "<u8"))]
                    mark = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(mark, bad, 1)
                    np.add.at(mark, bad + window, -1)
                    drop = np.cumsum(mark)[:n] > 0
                    gone = int(drop.sum())
                    words = [w for w, x in zip(words, drop.tolist(), strict=True) if not x]
                kept = t if verbatim and not gone else b" ".join(words).decode()
                out.append((i, n, gone, kept))
            columns = [*zip(*out, strict=True)] or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield _batch(["doc_id", "n_words", "n_removed", "kept", *own], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *(column_of(batch, n) for n in own))

    final = marked.join(repeats, marked["doc_id"] == repeats["hit_id"], "left").select("doc_id", "text", "hits", "repeats", "_id", *own)
    schema = ", ".join([KEPT, *(f"{n} {rows.schema[n].dataType.simpleString()}" for n in own)])
    cut_rows = final.mapInArrow(cut, schema)
    return cut_rows.select("doc_id", "n_words", "n_removed", "kept", *(F.col(n).alias(c) for n, c in zip(own, carry, strict=True)))


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """The rows of docs, all columns, without repeated words (see remove_repeats); rows left without any word go.

    A text that loses nothing stays as it is. n_chars, if there, is that of the new text.
    """
    names = docs.columns
    carry = tuple(c for c in names if c not in ("doc_id", "text"))
    out = remove_repeats(docs, window, carry=carry, verbatim=True)
    # Inner names first, as a carried column may be called like one of them.
    out = out.toDF("doc_id", "_n_words", "_n_removed", "text", *(f"_{i}" for i in range(len(carry))))
    out = out.where("_n_removed < _n_words or _n_words = 0")
    place = {c: f"_{i}" for i, c in enumerate(carry)}
    columns = {c: F.col(place.get(c, c)) for c in names}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(v.alias(c) for c, v in columns.items()))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: What op8_substring_dedup gives, for DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50
), f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY sha256(array_to_string(ws[p : p + 49], ' '))) AS lowest FROM p
), g AS (
  SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM f WHERE lowest < doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
