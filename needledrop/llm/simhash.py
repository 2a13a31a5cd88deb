"""SimHash fingerprints and near copies by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import NULL_ID, WordHashes, bounded_batches, column_of, give_back, held, mix, pack, pack_sorted, partitions_for, slices, texts_of, unpack, unpack_sorted, whole_rows, with_ids, written
from needledrop.llm.components import connected_components
from needledrop.llm.substring import window_hashes

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the XXH64 values of the text's word shingles; 0 without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    values = np.array([h(line[a:b], seed) for a, b in zip(starts, stops, strict=False)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), BLOCK):
        some = values[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("simhash",), dict)  # what other operators held goes
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return with_ids(docs, text, doc_id).mapInArrow(run, "doc_id long, fp long")


@cache
def flips(bits: int, most: int) -> np.ndarray:
    """Every mask over the lowest `bits` bits with at most `most` bits set."""
    return np.array([sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(bits), k)], dtype=np.uint64)


#: Variants that a task enumerates at a time.
VARIANTS = 1 << 21
#: From so many fingerprints with one leading value, its variants are dealt by SPLIT_BITS further bits.
HOT, SPLIT_BITS = 1 << 16, 4


def shared_variants(fps: np.ndarray, used: np.ndarray, tail: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners (places in fps) of the variants that several share, by variant: where each variant's owners start, and the owners.

    used: the flips that each fingerprint has spent on the bits above the lowest `tail`; at most `half` in all. Too many
    variants for one go are enumerated by the value of their next bits, as often as needed: what is held at a time has a
    bound whatever the number of fingerprints near one value.
    """
    many = sum(int((used == k).sum()) * len(flips(tail, half - k)) for k in range(half + 1))
    if many > VARIANTS and tail:
        step = min(SPLIT_BITS, tail)
        top = (fps >> np.uint64(tail - step)) & np.uint64((1 << step) - 1)
        for value in range(1 << step):
            now = used + np.bitwise_count(top ^ np.uint64(value))
            near = np.flatnonzero(now <= half)
            if len(near) > 1:
                for starts, owners in shared_variants(fps[near], now[near], tail - step, half):
                    yield starts, near[owners]
        return
    mask = np.uint64((1 << tail) - 1)
    owners, variants = [], []
    for k in range(half + 1):
        own = np.flatnonzero(used == k)
        rest = flips(tail, half - k)
        variants.append(((fps[own] & mask)[:, None] ^ rest[None, :]).ravel())
        owners.append(np.repeat(own, len(rest)))
    owners, variants = np.concatenate(owners), np.concatenate(variants)
    s = np.sort(variants)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return
    # A table of hashed values leaves few variants for the exact search.
    slot = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
    seen = np.zeros(1 << 22, dtype=bool)
    seen[slot(twice)] = True
    near = np.flatnonzero(seen[slot(variants)])
    order = np.lexsort((owners[near], variants[near]))
    v, o = variants[near][order], owners[near][order]
    starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    several = np.diff(np.append(starts, len(v))) > 1
    keep = np.repeat(several, np.diff(np.append(starts, len(v))))
    sizes = np.diff(np.append(starts, len(v)))[several]
    if len(sizes):
        yield np.cumsum(sizes) - sizes, o[keep]


def stars(starts: np.ndarray, owners: np.ndarray, tags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each variant's first owner with each further one."""
    first = np.repeat(owners[starts], np.diff(np.append(starts, len(owners))))
    other = first != owners
    return first[other], owners[other]


def across(starts: np.ndarray, owners: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each variant's owners with its owners of another tag."""
    low, high = np.minimum.reduceat(tags[owners], starts), np.maximum.reduceat(tags[owners], starts)
    stops = np.append(starts[1:], len(owners))
    left, right = [owners[:0]], [owners[:0]]
    for at in np.flatnonzero(low != high):
        some = owners[starts[at] : stops[at]]
        for k in range(0, len(some), 512):
            i, j = np.nonzero(tags[some[k : k + 512]][:, None] < tags[some][None, :])
            left.append(some[k : k + 512][i])
            right.append(some[j])
    return np.concatenate(left), np.concatenate(right)


def low_bits(d: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The lowest n (at most `most`) set bits of each d."""
    out = np.zeros_like(d)
    for k in range(most):
        low = d & (~d + np.uint64(1))
        out |= np.where(n > k, low, np.uint64(0))
        d = d ^ low
    return out


def meeting(p: np.ndarray, q: np.ndarray, tail: int, step: int, half: int) -> np.ndarray:
    """The bits above the lowest `tail - step` of one variant that both p and q have, for pairs within twice `half`.

    Of the bits above `tail` that differ, p flips as few as leave q within half, then of the next `step` bits. So the bits
    above `tail` don't depend on step.
    """
    p, q = np.minimum(p, q), np.maximum(p, q)
    top = p >> np.uint64(tail)
    d = top ^ (q >> np.uint64(tail))
    many = np.bitwise_count(d).astype(np.int64)
    spent = np.maximum(many - half, 0)
    top = top ^ low_bits(d, spent, half)
    if not step:
        return top
    mask = np.uint64((1 << step) - 1)
    sub = (p >> np.uint64(tail - step)) & mask
    d = sub ^ ((q >> np.uint64(tail - step)) & mask)
    spent = np.maximum(np.bitwise_count(d).astype(np.int64) - (half - many + spent), 0)
    return top << np.uint64(step) | sub ^ low_bits(d, spent, half)


#: Fingerprints on the sides of a tile, at most: those that are held, and those that come one after another.
HELD, PASSING = 256, 512


def tiles_of(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Pairs a, b (ordered by a) as tiles: what is held, what passes, and for each of the latter its partners among the former."""
    held_side = np.unique(a)
    for c in range(0, len(held_side), HELD):
        some = held_side[c : c + HELD]
        x, y = np.searchsorted(a, some[0]), np.searchsorted(a, some[-1], side="right")
        order = x + np.lexsort((a[x:y], b[x:y]))
        passing = _runs(b[order])
        for e in range(0, len(passing), PASSING):
            runs = passing[e : e + PASSING]
            partners = [a[order[i:j]] for i, j in runs]
            yield np.unique(np.concatenate(partners)), b[order[[i for i, _ in runs]]], partners


def ball_pairs(fps: DataFrame, bits: int, radius: int, tagged: bool = False, tiled: bool = False) -> DataFrame:
    """t, a, b: pairs of fingerprints of a table t at `radius` or fewer differing bits, by meet-in-the-middle ball hashing.

    fps: t int, fp long (the lowest `bits` bits); equal rows count once. Every fingerprint stands for all variants within half the
    radius; two within the radius share one. The shuffle goes by a table and a variant's leading bits: a task sends all
    its fingerprints for one such value as one row, each fingerprint to every value that its variants can have, and
    the receiver enumerates the variants of that value, so a thousand variants cost some tens of numbers. Values
    that many fingerprints have are dealt by further bits. What shares a variant is verified.

    A variant's owners are paired with the first of them (in an order that is the same everywhere), so every link is a path of
    at most two pairs. tagged: rows have a tag long too, pairs are those of different tags, all of them; a tag of 0
    differs from every other, but for that of the same fingerprint.

    tiled: instead of a row for each pair t, tile, side, fp, tag, places: a row for each fingerprint of a tile, so that the rows
    are at most the tables and leading values times the fingerprints for groups within a tile's size, whatever the
    number of pairs. Side 0 is held, its place is in places (int32); side 1 has the places of its partners. A pair is
    in one tile only, that of the variant given by meeting(). Without tags, not every variant's star is whole then.
    """
    half = radius // 2
    n = fps.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    # As many leading bits as leave VARIANTS variants for each of their values.
    lead = int(np.clip(np.ceil(np.log2(max(1, n) * len(flips(bits, half)) / VARIANTS)), 4, 24))
    tail = bits - lead
    hot = fps.groupBy("t", F.shiftrightunsigned("fp", tail).alias("lead")).count().where(F.col("count") > HOT)
    hot = {(r["t"], r["lead"]) for r in hot.collect()}  # at most one for each HOT fingerprints
    names = ["t", "lead", "sub", "fps", "tags"]
    if tagged and not tiled:
        raise ValueError("pairs of tags come as tiles")
    schema = "t int, lead long, sub int, fps binary, tags binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("simhash",), dict)
        t, fp, tag = [], [], []
        for batch in batches:
            t.append(np.array(column_of(batch, "t")))
            fp.append(np.array(column_of(batch, "fp")).view(np.uint64))
            tag.append(np.array(column_of(batch, "tag")) if tagged else t[-1])
            if sum(map(len, t)) >= 1 << 20:
                yield from cut(*map(np.concatenate, (t, fp, tag)))
                t, fp, tag = [], [], []
        if t:
            yield from cut(*map(np.concatenate, (t, fp, tag)))

    def cut(t: np.ndarray, fp: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((tag, fp, t))
        order = order[[x for x, _ in _runs(t[order], fp[order], tag[order])]] if len(order) else order
        t, fp, tag = t[order], fp[order], tag[order]
        for mask in flips(lead, half):
            value = (fp >> np.uint64(tail)) ^ mask
            spent = int(mask).bit_count()
            by = np.lexsort((fp, value, t))
            rows = []
            for x, y in _runs(t[by], value[by]):
                own = by[x:y]
                key = int(t[own[0]]), int(value[own[0]])
                if key not in hot:
                    rows.append((*key, -1, own))
                    continue
                top = (fp[own] >> np.uint64(tail - SPLIT_BITS)) & np.uint64((1 << SPLIT_BITS) - 1)
                for sub in range(1 << SPLIT_BITS):
                    near = own[np.bitwise_count(top ^ np.uint64(sub)) <= half - spent]
                    if len(near):
                        rows.append((*key, sub, near))
            for k in range(0, len(rows), 4096):
                a, b, c, own = zip(*rows[k : k + 4096], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array([pack_sorted(fp[o]) for o in own], pa.binary()), pa.array([pack(tag[o]) if tagged else None for o in own], pa.binary())],
                    names=names,
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        key, parts = None, []
        for batch in batches:
            for t, value, sub, some, tags in zip(*(column_of(batch, c).to_pylist() for c in names), strict=True):
                if (t, value, sub) != key:
                    yield from pairs(key, parts)
                    key, parts = (t, value, sub), []
                parts.append((unpack_sorted(some), unpack(tags, "<i8") if tagged else None))
        yield from pairs(key, parts)

    def pairs(key: tuple[int, int, int] | None, parts: list) -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        t, value, sub = key
        fp = np.concatenate([f for f, _ in parts])
        tags = np.concatenate([g for _, g in parts]) if tagged else np.zeros(len(fp), dtype=np.int64)
        order = np.lexsort((tags, mix(fp)))
        order = order[[x for x, _ in _runs(fp[order], tags[order])]]
        fp, tags = fp[order], tags[order]
        own_tags = np.where(tags == 0, -1 - np.arange(len(tags)), tags)
        used = np.bitwise_count((fp >> np.uint64(tail)) ^ np.uint64(value)).astype(np.int64)
        rest = tail
        if sub >= 0:
            rest = tail - SPLIT_BITS
            used += np.bitwise_count(((fp >> np.uint64(rest)) & np.uint64((1 << SPLIT_BITS) - 1)) ^ np.uint64(sub))
        found = np.zeros(0, dtype=np.int64)
        waiting, size = [], 0

        def settled() -> np.ndarray:
            return np.unique(np.concatenate([found, *waiting]))

        for starts, owners in shared_variants(fp, used, rest, half):
            a, b = (across if tagged else stars)(starts, owners, own_tags)
            good = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            if tiled:
                good &= meeting(fp[a], fp[b], tail, tail - rest, half) == np.uint64(value if sub < 0 else value << SPLIT_BITS | sub)
            waiting.append(np.unique(a[good] * len(fp) + b[good]))
            size += len(waiting[-1])
            if size > 1 << 21:
                found, waiting, size = settled(), [], 0
        found = settled()
        if tiled:
            for k, (low, high, partners) in enumerate(tiles_of(*np.divmod(found, len(fp)))):
                both = np.concatenate((low, high))
                places = [np.int32(i).tobytes() for i in low] + [p.astype("<i4").tobytes() for p in partners]
                columns = [np.full(len(both), t, np.int32), [f"{t}.{value}.{sub}.{k}"] * len(both), np.repeat(np.array([0, 1], np.int32), (len(low), len(high))), fp[both].view(np.int64), tags[both], places]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["t", "tile", "side", "fp", "tag", "places"])
            return
        for at in range(0, len(found), 100_000):
            a, b = np.divmod(found[at : at + 100_000], len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), t, np.int32)), pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["t", "a", "b"])

    dealt = fps.mapInArrow(deal, schema).repartition(partitions_for(fps), "t", "lead", "sub").sortWithinPartitions("t", "lead", "sub")
    if tiled:
        return dealt.mapInArrow(meet, "t int, tile string, side int, fp long, tag long, places binary")
    return dealt.mapInArrow(meet, "t int, a long, b long").distinct()


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys start and end."""
    if not len(keys[0]):
        return []
    cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(keys[0])]
    return [*zip(cuts[:-1], cuts[1:], strict=True)]


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links a, b between distinct 64-bit fingerprints of fps (fp long, distinct): see ball_pairs."""
    return ball_pairs(fps.select(F.lit(0).alias("t"), "fp"), 64, radius).select("a", "b")


def near_copies(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) for every row of docs.

    Equal fingerprints are one class from the start (linked whatever their number), so thousands of copies cost one row
    in the search. Links are between fingerprints; components and their smallest ids go back to the rows by a join.

    Null or empty text, or one of white space only: fingerprint 0, linked like any other. Null ids count for no
    component_id; a component of null ids only has null. Repeated rows each give a row. An empty table gives no row.
    """
    rows = written(fingerprints(docs, shingle, seed, text, doc_id), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = connected_components(near_links(classes.select("fp"), radius))
    joined = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    of_class = joined.join(roots, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(of_class, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")


#: Odd multiplier of the hashes whose bits are the fingerprints of a set.
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the runs of `size` words (A-Z in lower case), in order; a shorter text is one run."""
    # Under the name of window_hashes' own stores, as those of another operator would go at every text.
    words = held(("substring", "shingle words"), lambda: WordHashes(6))(text.encode().lower().split())
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), 5)).view(np.int64))


def set_fingerprints(sets: list[np.ndarray], tables: int, bits: int) -> np.ndarray:
    """A row of `tables` independent SimHash fingerprints of `bits` bits for each set: a bit is set if it is in over half of the hashes.

    Bits are counted eight at a time: each byte of a word counts one bit of at most 255 shingles.
    """
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    words = -(-tables * bits // 64)
    ones = np.zeros((len(sets), words * 64), dtype=np.int64)
    full = np.flatnonzero(lengths)
    for x, y in slices(lengths[full], 1 << 15):
        some = full[x:y]
        flat = np.concatenate([sets[i] for i in some])
        parts = -(-lengths[some] // 255)
        first = np.cumsum(parts) - parts
        within = np.arange(parts.sum()) - np.repeat(first, parts)
        starts = np.repeat(np.cumsum(lengths[some]) - lengths[some], parts) + 255 * within
        for w in range(words):
            h = mix((flat + np.uint64(w + 1)) * ODD)
            for k in range(8):
                sums = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
                lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
                ones[some[:, None], 64 * w + 8 * np.arange(8)[None, :] + k] = lanes
    on = (2 * ones > lengths[:, None])[:, : tables * bits].reshape(len(sets), tables, bits)
    return (on * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


#: Tables of the first search.
FIRST = 4


def similar_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5, tables: int = 24, bits: int = 48, radius: int = 4) -> DataFrame:
    """id (NULL_ID for null), cls, component_id (smallest id reachable over links) for every row of docs.

    Two texts are linked if the sets of their runs of `shingle` words have a Jaccard similarity of `least` or more. Rows of
    equal sets are one class from the start, so copies cost one row in the search.

    Candidates: every set has `tables` independent fingerprints of `bits` bits; each table's distinct fingerprints go
    through ball hashing with `radius` (see ball_pairs). A bit of two sets of similarity s differs with probability
    acos(2s / (1 + s)) / pi, so a table shows a pair of similarity 0.8 with 0.13, one of 0.9 with 0.44, and all 24 show
    0.96 and over 0.999 of them; sets of under ten shingles less (0.7 at 0.8). Each candidate is verified on the sets.

    The first search takes FIRST tables, pairs a variant's owners with one of them each and so joins large groups by few pairs.
    The second takes all tables and pairs all owners of a variant that are still in different components, so that no pair
    with a common variant is missed, and a large group isn't compared with itself again. Candidates are never rows: both
    searches give tiles, with a row for each class in a tile, whose sets are compared where they meet; a tile returns
    as many links as join its classes. The second search's links join the components of the first.

    Null or empty text, or one of white space only: the empty set, one class. Null ids count as larger than every other.
    Repeated rows each give a row; an empty table gives no row.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in texts_of(batch)]
            fps = set_fingerprints(sets, tables, bits)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, tables, dtype=np.int32)), pa.array(fps.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array([set_hash(s) for s in sets], pa.int64()), values], names=["id", "cls", "prints"])

    rows = bounded_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(rows.mapInArrow(sign, "id long, cls long, prints array<long>"), "fingerprints")
    classes = written(signed.groupBy("cls").agg(F.min("id").alias("least"), F.min("prints").alias("prints")), "classes")

    # The first search: equal fingerprints and the owners of a variant, each with the first. Tag 0 is a class without another.
    prints = classes.select("cls", F.posexplode(F.slice("prints", 1, FIRST)).alias("t", "fp"))
    firsts = written(prints.groupBy("t", "fp").agg(F.min("cls").alias("first"), F.count("*").alias("n")), "first-owners")
    chunks = F.ceil(F.col("n") / PASSING)
    shared = firsts.where("n > 1").select(F.col("t").alias("u"), F.col("fp").alias("f"), "first", chunks.alias("chunks"))
    tile = lambda kind, *names: F.concat_ws(".", F.lit(kind), *names).alias("tile")
    row = lambda side, cls, tag: (F.lit(side).alias("side"), F.col(cls).alias("cls"), F.lit(tag).cast("long").alias("tag"), F.lit(None).cast("binary").alias("places"))
    one = shared.select("u", "f", "first", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(tile("equal", "u", "f", "chunk"), *row(0, "first", 0))
    others = prints.join(shared, (F.col("t") == F.col("u")) & (F.col("fp") == F.col("f"))).where("cls <> first")
    others = others.select(tile("equal", "u", "f", F.pmod(F.xxhash64("cls"), "chunks")), *row(1, "cls", 0))
    near = ball_pairs(firsts.select("t", "fp"), bits, radius, tiled=True)
    near = near.join(firsts.select(F.col("t").alias("u"), F.col("fp").alias("f"), "first"), (F.col("t") == F.col("u")) & (F.col("fp") == F.col("f"))).select("tile", "side", F.col("first").alias("cls"), "tag", "places")
    found = written(_joined(written(near.union(one).union(others), "tiles"), classes, rows, least, shingle), "similar")

    # The second: owners of a variant in different components.
    groups = written(connected_components(found).withColumnRenamed("node", "cls"), "groups")
    tag = F.coalesce(F.when(F.col("component") == 0, 1).otherwise(F.col("component")), F.lit(0)).alias("tag")
    tags = written(classes.join(groups, "cls", "left").select("cls", tag, "prints"), "tagged")
    prints = tags.select("cls", "tag", F.posexplode("prints").alias("t", "fp"))
    apart = written(ball_pairs(prints.select("t", "fp", "tag"), bits, radius, tagged=True, tiled=True), "apart")
    owners = prints.select(F.col("t").alias("u"), F.col("fp").alias("f"), F.col("tag").alias("g"), "cls")
    apart = apart.join(owners, (F.col("t") == F.col("u")) & (F.col("fp") == F.col("f")) & (F.col("tag") == F.col("g"))).select("tile", "side", "cls", "tag", "places")
    # Those without another that have a fingerprint in common: chunks, each with itself and the later ones.
    chunks = F.ceil(F.col("n") / HELD)
    alone = prints.where("tag = 0").groupBy("t", "fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("t").alias("u"), F.col("fp").alias("f"), chunks.alias("chunks"))
    alone = prints.where("tag = 0").join(alone, (F.col("t") == F.col("u")) & (F.col("fp") == F.col("f"))).select("t", "fp", "cls", F.pmod(F.xxhash64("cls"), "chunks").alias("chunk"))
    one = alone.select(tile("alone", "t", "fp", "chunk"), *row(0, "cls", 0))
    others = alone.select("t", "fp", "cls", F.explode(F.sequence(F.lit(0), "chunk")).alias("k")).select(tile("alone", "t", "fp", "k"), *row(1, "cls", 0))
    more = _joined(written(apart.union(one).union(others), "tiles"), classes, rows, least, shingle)
    groups = connected_components(groups.select(F.col("cls").alias("a"), F.col("component").alias("b")).union(more))
    joined = classes.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("component", "cls").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    of_class = joined.join(roots, F.col("root") == F.col("r")).select(F.col("cls").alias("c"), "component_id")
    return signed.join(of_class, F.col("cls") == F.col("c")).select("id", "cls", "component_id")


class Forest:
    """Which of some nodes hang together."""

    def __init__(self):
        self.up: dict = {}

    def root(self, node):
        while (up := self.up.get(node, node)) != node:
            self.up[node] = node = self.up.get(up, up)
        return node

    def join(self, a, b) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of a sorted set each of the others has."""
    if not len(one):
        return np.zeros(len(others), dtype=np.int64)
    flat = np.concatenate(others)
    hits = np.append(0, np.cumsum(one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat))
    ends = np.cumsum([len(x) for x in others])
    return hits[ends] - hits[np.append(0, ends[:-1])]


def _joined(tiles: DataFrame, classes: DataFrame, rows: DataFrame, least: float, shingle: int) -> DataFrame:
    """a, b: classes whose sets have a Jaccard similarity of `least` or more, as many pairs of a tile as join all that such pairs join.

    tiles: tile string, side, cls, tag, places (see ball_pairs; null: all); classes of one tag other than 0 hang together
    already. The sets are made anew, for the classes of the tiles.
    """
    wanted = classes.join(tiles.select(F.col("cls").alias("node")).distinct(), F.col("cls") == F.col("node"), "left_semi").select(F.col("least").alias("wanted")).distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, forest = None, {}, Forest()
        for batch in batches:
            links = []
            for tile, side, cls, tag, places, shingles in zip(*(column_of(batch, c).to_pylist() for c in ("tile", "side", "cls", "tag", "places")), column_of(batch, "shingles"), strict=True):
                if tile != now:
                    now, kept, forest = tile, {}, Forest()
                own, of = np.frombuffer(shingles.as_buffer(), "<u8"), tag or cls
                if side == 0:
                    kept.setdefault(None if places is None else int.from_bytes(places, "little"), []).append((cls, of, own))
                    continue
                root = forest.root(of)
                some = [x for p in ([None] if places is None else np.frombuffer(places, "<i4").tolist()) for x in kept.get(p, ()) if x[0] != cls and forest.root(x[1]) != root]
                if not some:
                    continue
                both = overlaps(own, [x[2] for x in some])
                for (other, its, s), n in zip(some, both.tolist(), strict=True):
                    if n >= least * (len(own) + len(s) - n) and forest.join(of, its):
                        links.append((other, cls))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    made = rows.join(wanted, F.col("id") == F.col("wanted"), "left_semi").select("text").mapInArrow(sets_of, "node long, shingles binary")
    sets = written(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    met = tiles.join(sets, F.col("cls") == F.col("node")).select("tile", "side", "cls", "tag", "places", "shingles")
    return met.repartition(partitions_for(rows), "tile").sortWithinPartitions("tile", "side").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, less all but one of each group of near copies (see similar_copies): the one of smallest doc_id stays.

    Of rows with equal id and set of shingles one stays. Of a group without any id, one row for each set stays. An
    empty table stays empty.
    """
    kept = similar_copies(docs, least).where("component_id = id").select(F.col("id").alias("kept_id"), F.col("cls").alias("kept_cls")).distinct()
    kept = written(kept, "kept")
    rows = docs.select(whole_rows(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
    # Ids alone meet the texts. Those that aren't unique are told apart by their sets.
    odd = written(rows.groupBy("id").agg(F.count("*").alias("n")).where(f"n > 1 or id = {NULL_ID}").select(F.col("id").alias("odd_id")), "repeated-ids")
    single = rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    if odd.isEmpty():
        return single.select("row.*")

    @F.pandas_udf("long")
    def cls(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: set_hash(shingle_set(t or "")))

    plain = single.join(odd, F.col("id") == F.col("odd_id"), "left_anti")
    some = rows.join(odd, F.col("id") == F.col("odd_id"), "left_semi").withColumn("cls", cls("row.text"))
    some = some.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("cls") == F.col("kept_cls")), "left_semi").dropDuplicates(["id", "cls"])
    return plain.select("row.*").unionByName(some.select("row.*"))


def hex_digits(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed long column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
