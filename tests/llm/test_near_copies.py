"""Near copies by shingles against brute force, and their recall on planted copies."""

from __future__ import annotations

import random

import numpy as np

from needledrop.llm import simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts, least=0.8):
    ids = sorted(texts)
    sets, low = {i: plain_set(texts[i]) for i in ids}, {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if low[i] != low[j] and similarity(sets[i], sets[j]) >= least:
                old, new = max(low[i], low[j]), min(low[i], low[j])
                low = {k: new if v == old else v for k, v in low.items()}
    return low


def test_stage_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    low = brute_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = corpus_pipeline.near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*low.values()})
    assert corpus_pipeline.near_copies(spark, docs.limit(0), sf_dir).count() == 0


def test_recall_on_planted_copies(spark):
    """Copies with one to several changed words, from a similarity of 0.8 on."""
    random.seed(3)
    rows, pairs = [], []
    for i in range(600):
        words = [f"w{random.randrange(5000)}" for _ in range(random.choice([60, 100, 200, 400]))]
        copy = list(words)
        for at in random.sample(range(len(copy)), random.randint(1, max(1, len(copy) // 45))):
            copy[at] = f"new{random.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        if similarity(plain_set(rows[-2][1]), plain_set(rows[-1][1])) >= 0.8:
            pairs.append(2 * i + 1)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, _ in rows} - kept
    assert len(pairs) > 200
    assert gone <= {*pairs}
    assert len(gone) >= 0.98 * len(pairs)


def test_large_group_and_odd_rows(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(words)
        copy[random.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy), "r"))
    rows += [(1000, None, "n"), (1001, "", "n"), (1002, "one two", "s"), (1003, "One  two", "s"), (1004, "b", "t"), (1004, "c", "t"), (1004, "c", "t"), (None, "without an id", "u")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, cls string")).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept if r["cls"] != "n") == sorted([(0, rows[0][1]), (1002, "one two"), (1004, "b"), (1004, "c"), (-1, "without an id")])
    assert [r["doc_id"] for r in kept if r["cls"] == "n"] == [1000]


def test_no_pair_with_a_common_variant_is_missed(spark, monkeypatch):
    """Families whose members are just below and above the similarity: the first owner of a variant often isn't the partner."""
    monkeypatch.setattr(simhash, "VARIANTS", 1 << 12)
    monkeypatch.setattr(simhash, "HOT", 40)
    random.seed(12)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for _ in range(40):
            copy = list(base)
            for at in random.sample(range(120), random.randint(0, 3)):
                copy[at] = random.choice(["x", "y", "z"]) + str(at)
            rows.append((len(rows), " ".join(copy)))
    sets = [simhash.shingle_set(t) for _, t in rows]
    fps = simhash.set_fingerprints(sets, 24, 48)
    low = {i: i for i, _ in rows}
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both) and np.bitwise_count(fps[i] ^ fps[j]).min() <= 4:
                linked += 1
                old, new = max(low[i], low[j]), min(low[i], low[j])
                low = {k: new if v == old else v for k, v in low.items()}
    found = {r["id"]: r["component_id"] for r in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert linked > 500
    assert found == low


def test_fingerprints_of_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 3, 254, 255, 256, 600, 40_000)] + [np.zeros(0, dtype=np.uint64)]
    for s, row in zip(sets, simhash.set_fingerprints(sets, 3, 48).tolist(), strict=True):
        bits = []
        for w in range(3):
            h = simhash.mix((s + np.uint64(w + 1)) * simhash.ODD)
            # Within a word the bits of its bytes, lowest first.
            bits += [2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(s) for b in range(64)]
        assert row == [sum(x << i for i, x in enumerate(bits[48 * t : 48 * t + 48])) for t in range(3)]


def test_rows_follow_documents_not_pairs(spark, monkeypatch):
    """A large group most of whose pairs lie about the similarity: no table and no list of links grows with its pairs."""
    random.seed(21)
    base, rows = [f"b{i}" for i in range(146)], []
    for i in range(700):
        copy = list(base)
        for at in random.sample(range(146), random.randint(1, 3)):
            copy[at] = f"n{i}.{at}"
        rows.append((i, " ".join(copy)))
    most = {}
    written, components = simhash.written, simhash.connected_components

    def counted(df, name):
        out = written(df, name)
        most[name] = max(most.get(name, 0), out.count())
        return out

    def linked(links):
        most["links"] = max(most.get("links", 0), links.count())
        return components(links)

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(simhash, "connected_components", linked)
    found = {r["id"]: r["component_id"] for r in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert most["links"] <= 4 * simhash.FIRST * len(rows), most
    assert max(most.values()) <= 3 * 24 * len(rows), most
    sets = [simhash.shingle_set(t) for _, t in rows]
    fps = simhash.set_fingerprints(sets, 24, 48)
    low = np.arange(len(rows))
    for i, a in enumerate(sets):
        for j in np.flatnonzero((np.bitwise_count(fps[i] ^ fps[:i]) <= 4).any(axis=1)):
            if low[i] != low[j] and (both := len(np.intersect1d(a, sets[j]))) >= 0.8 * (len(a) + len(sets[j]) - both):
                low[low == max(low[i], low[j])] = min(low[i], low[j])
    assert found == {i: int(x) for i, x in enumerate(low)}


def test_each_pair_is_in_one_tile(spark):
    """Of hot leading values too; equal tags don't meet, those of tag 0 do."""
    rng = np.random.default_rng(4)
    fps = np.unique(np.bitwise_xor.reduce(np.where(rng.random((600, 5)) < 0.7, np.uint64(1) << rng.integers(0, 24, (600, 5)).astype(np.uint64), np.uint64(0)), axis=1))
    tags = rng.integers(0, 4, len(fps))
    want = {(int(a), int(b)) for i, a in enumerate(fps) for j, b in enumerate(fps) if a < b and int(a ^ b).bit_count() <= 4 and (tags[i] != tags[j] or tags[i] == 0)}
    table = spark.createDataFrame([(0, int(f), int(g)) for f, g in zip(fps, tags)], "t int, fp long, tag long")
    for hot in (10, 1 << 16):
        simhash.HOT, old = hot, simhash.HOT
        try:
            tiles = simhash.ball_pairs(table, 24, 4, tagged=True, tiled=True).collect()
        finally:
            simhash.HOT = old
        held = {(r["tile"], bytes(r["places"])): r["fp"] for r in tiles if r["side"] == 0}
        met = [tuple(sorted((r["fp"], held[r["tile"], bytes(r["places"][k : k + 4])]))) for r in tiles if r["side"] == 1 for k in range(0, len(r["places"]), 4)]
        assert len(met) == len(set(met)) and set(met) == want
