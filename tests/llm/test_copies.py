"""Near copies, embeddings, repeated passages and WARC records against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import numpy as np
import pytest

from needledrop.llm import components, embedding_dedup, simhash, substring, warc


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    random.seed(2)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    u = Union()
    for a, b in links:
        if a is not None and a != b:
            u.join(a, b)
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: u.find(x) for x in u.up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    import re

    import xxhash

    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    u = Union()
    for i, a in enumerate(ids):
        u.find(a)
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                u.join(a, ids[j])
    return {i: u.find(i) for i in ids}


def test_simhash(spark, sf_dir):
    extra = [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b"), (9004, "a B"), (9005, "Ä b c d e")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    rows = {r["doc_id"]: r for r in simhash.near_copies(docs).collect()}
    assert {i: rows[i]["fp"] % 2**64 for i in ids} == dict(zip(ids, fps, strict=True))
    assert {i: rows[i]["component_id"] for i in ids} == brute_components(ids, fps)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_ball_hashing_finds_every_link(spark):
    random.seed(4)
    fps = [random.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for k in (1, 2, 3, 4, 5):
            g = f
            for b in random.sample(range(64), k):
                g ^= 1 << b
            fps.append(g)
    fps = sorted({*fps})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    u = Union()
    for r in simhash.near_links(df).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        assert (a ^ b).bit_count() <= 4
        u.join(a, b)
    assert {f: u.find(f) for f in fps} == brute_components(fps, fps)


def test_keep_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x"), (2, text, "y"), (3, "other words altogether here", "z"), (3, "quite different from all of those", "z"), (1, text, "again"), (None, "no id at all in this one", "n")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _fp string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, rows[5][1]), (1, text), (3, rows[2][1]), (3, rows[3][1])])


def brute_links(rows, least=0.93):
    by, n, u = {}, [0] * len(rows), Union()
    for i, (_, label, e) in enumerate(rows):
        u.find(i)
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            by.setdefault((label, len(e)), []).append(i)
    for group in by.values():
        x = np.array([rows[i][2] for i in group], dtype=float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            n[group[a]] += 1
            n[group[b]] += 1
            u.join(group[a], group[b])
    low = {}
    for i, r in enumerate(rows):
        low[u.find(i)] = min(low.get(u.find(i), 1 << 60), r[0])
    return {r[0]: (n[i], low[u.find(i)]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [2048, 40])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres, rows = rng.normal(size=(12, 64)), []
    for i in range(900):
        k = int(rng.integers(0, 12))
        e = centres[k] + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.3, 0.4]) if i % 3 else rng.normal(size=64)
        rows.append((i, k % 3 if i % 50 else None, [float(np.float32(x)) for x in e]))
    rows += [(5000, 1, None), (5001, 1, [0.0] * 64), (5002, 1, [1.0] * 63 + [float("nan")]), (5003, 1, [1.0] * 63 + [None]), (5004, rows[5][1], rows[5][2]), (5005, rows[5][1], rows[5][2]), (5006, 1, [1.0, 2.0]), (5007, 1, [2.0, 4.0]), (5008, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as node", "2 as list")
    want = brute_links(rows)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_copies(df).collect()}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in embedding_dedup.near_copies(df.limit(20)).collect())
    # Links found are links, and recall over links is at least 0.99 (it is 1 here).
    assert set(found) == set(want)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert found == want


@pytest.mark.parametrize(("dim", "n_lists", "per_vector"), [(2, 1024, 12), (3, 1024, 12), (4, 2048, 16), (7, 1024, 12), (8, 1024, 12), (8, 2048, 16), (12, 1024, 12), (16, 1024, 12), (64, 1024, 12), (64, 2048, 16), (64, 5000, 16), (64, 16384, 16), (256, 1024, 12), (768, 2048, 16)])
def test_recall_at_the_bound(dim, n_lists, per_vector):
    """Pairs at cosine 0.93: how many collide twice or more, and (from 64 dimensions on) how many unrelated ones do."""
    n_lists, per_vector = embedding_dedup.lists_of(dim, n_lists, per_vector)
    rng = np.random.default_rng(dim + n_lists)
    a, b = rng.normal(size=(2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    one, two = ({k: v for k, v in zip(("lists", "values"), embedding_dedup.farthest(x.astype(np.float32), n_lists, per_vector, 3), strict=True)} for x in (a, b))
    assert (np.diff(one["lists"], axis=1) > 0).all() and one["lists"].max() < n_lists
    at, reach = np.arange(1500), np.sqrt(0.14) + 1e-4
    assert (embedding_dedup.window_collisions(one, at, two, at, reach)[0] >= 2).mean() >= 0.995
    assert (embedding_dedup.window_collisions(one, at, two, np.roll(at, 1), reach)[0] >= 2).mean() < (0.05 if dim >= 64 else 1)


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 8])
def test_embeddings_in_few_dimensions(spark, monkeypatch, dim):
    """Every link is found, whatever the vectors' lengths: no square over- or underflows."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(350, dim)) * 10.0 ** rng.choice([-200, -100, 0, 100, 200], size=(350, 1))
    rows = [(i, i % 2, v) for i, v in enumerate(x.tolist())] + [(400, 0, [1e200] * dim), (401, 0, [1e200] * dim), (402, 0, [1e-200] * dim), (403, 0, [1.0] * dim), (404, 0, [5e-324] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_copies(df).collect()}
    assert found == brute_links([(i, label, (np.array(v) / np.abs(v).max()).tolist()) for i, label, v in rows])
    assert len({found[i][1] for i in (400, 401, 402, 403, 404)}) == 1
    assert embedding_dedup.near_copies(df.limit(0)).collect() == []


def test_window_collisions_against_brute_force():
    rng = np.random.default_rng(4)
    some = lambda: {"lists": np.sort(np.stack([rng.choice(20, 6, replace=False) for _ in range(40)]), axis=1), "values": rng.random((40, 6))}
    one, two = some(), some()
    i, j = rng.integers(0, 40, (2, 200))
    n, first = embedding_dedup.window_collisions(one, i, two, j, 0.3)
    for k, (a, b) in enumerate(zip(i, j, strict=True)):
        x, y = (dict(zip(s["lists"][r].tolist(), s["values"][r].tolist(), strict=True)) for s, r in ((one, a), (two, b)))
        hits = sorted(m for m in x if m in y and abs(x[m] - y[m]) <= 0.3)
        assert (n[k], first[k]) == (len(hits), hits[0] if hits else -1)


def test_many_lists(spark):
    """More lists than bits in a set: some are counted together there, none in the result."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 32))
    rows = [(i, 1, [float(np.float32(x)) for x in centres[i % 20] + rng.normal(size=32) * 0.25]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_copies(df, n_lists=3000, per_vector=16).collect()}
    assert found == brute_links(rows)


def brute_cut(rows, w=50):
    seen = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").encode().split()
        for p in range(len(words) - w + 1):
            seen.setdefault(tuple(words[p : p + w]), i)
    out = {}
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - w + 1):
            if seen[tuple(words[p : p + w])] != i:
                gone[p : p + w] = [True] * w
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(words, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("words", [1 << 20, 3000])
def test_substrings(spark, monkeypatch, words):
    monkeypatch.setattr(substring, "WORDS", words)
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    passages = [[random.choice(vocabulary) for _ in range(random.choice([49, 50, 51, 60, 75, 99, 130, 300]))] for _ in range(15)]
    rows = []
    for i in range(150):
        t = []
        for _ in range(random.randint(0, 6)):
            t += random.choice(passages) if random.random() < 0.4 else [random.choice(vocabulary) for _ in range(random.randint(1, 120))]
            if random.random() < 0.1:
                t += ["a"] * random.choice([49, 50, 60, 200])
        rows.append((i * 7 % 150 - 20, " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as hits", "'y' as kept").repartition(5)
    found = {r["doc_id"]: tuple(r)[1:] for r in substring.digest(df).collect()}
    assert found == brute_cut(rows)
    assert substring.digest(df.limit(0)).count() == 0


def test_passages_that_a_document_holds_twice(spark):
    """One document for each task: the earlier one's words are met in another task, at every place of the later one."""
    passage = " ".join(f"p{i}" for i in range(70))
    fill = lambda k: " ".join(f"f{k}x{i}" for i in range(37))
    lines = " ".join(["a"] * 200)
    rows = [(1, f"{fill(1)} {passage}"), (2, f"{passage} {fill(2)} {passage} {fill(3)} {passage}"), (3, lines), (4, f"{fill(4)} {lines} {fill(5)} {lines}"), (5, " ".join(["x y z"] * 90)), (6, " ".join(["x y z"] * 60) + " " + fill(6))]
    parts = spark.sparkContext.parallelize(rows, len(rows))
    df = spark.createDataFrame(parts, "doc_id long, text string")
    assert df.rdd.glom().map(len).collect() == [1] * len(rows)
    found = {r["doc_id"]: tuple(r)[1:] for r in substring.digest(df).collect()}
    assert found == brute_cut(rows)
    # Rows of one id in a task, the passage at different places of them.
    rows = [(1, passage), (2, f"{passage} {fill(7)}"), (2, f"{fill(8)} {passage}")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).coalesce(1), "doc_id long, text string")
    df = df.where("doc_id = 1").repartition(1).union(df.where("doc_id = 2"))
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(df).collect()) == [(1, 0), (2, 70), (2, 70)]


def test_layout_does_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, *others = ({r["doc_id"]: tuple(r) for r in substring.digest(docs.repartition(n)).collect()} for n in (1, 4, 64))
    assert all(one == other for other in others)


def test_largest_id_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2**63 - 1, long), (None, long), (None, long + " x"), (5, long)]
    found = [(r["doc_id"], r["n_removed"]) for r in substring.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=repr) == sorted([(2**63 - 1, 60), (None, 60), (None, 60), (5, 0)], key=repr)


def test_cut_keeps_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, long, "a", 5), (2, "start  " + long + " end", "b", 6), (3, long, "c", 7), (4, None, "d", 0)], "doc_id long, text string, kept string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["kept"], r["n_chars"]) for r in substring.cut_repeats(df).collect()}
    assert found == {1: (long, "a", 5), 2: ("start end", "b", 9), 4: ("", "d", 0)}


def test_equal_ids_do_not_cut_each_other(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = substring.remove_repeats(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc(spark, tmp_path):
    rows = [(3, "u", "x" * 100), (1, None, "x" * 100), (None, "u\r\n", "x" * 100), (5, "v", None), (6, "v", ""), (7, "q", "é" * 1000 + "\r\n\r\n"), (7, "q", "é" * 1000 + "\r\n\r\n"), (None, "a", "zz"), (None, "b", "zz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as chunk", "2 as digest").repartition(3)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path, chunk_bytes=64)
    found = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect()), key=repr)
    want = sorted(((i or 0, len((h or "").encode()), digest(h or ""), kind, to) for (i, _, h), (kind, to) in zip(rows, [("revisit", 1), ("response", None), ("revisit", 1), ("response", None), ("revisit", 5), ("response", None), ("response", None), ("response", None), ("response", None)], strict=True)), key=repr)
    assert found == want
    # The chunks of an archive, one after another, are a WARC file.
    chunks = spark.read.parquet(path).orderBy("archive", "record", "chunk").collect()
    assert max(len(r["data"]) for r in chunks) < 64 + 1000
    whole = b"".join(r["data"] for r in chunks)
    count = 0
    while whole:
        head, _, rest = whole.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        whole, count = rest[size + 4 :], count + 1
    assert count == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_heads_of_any_length(spark):
    urls = ["u" * n for n in (65_000, 65_300, 65_400, 65_536, 70_000, 1_200_000)]
    rows = [(i, url, html) for i, (url, html) in enumerate((u, h) for u in urls for h in (f"body of {len(u)}", "same", "x" * 3000 + f"{len(u)}"))]
    found = {r["page_id"]: (r["url"], r["payload_bytes"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk_bytes=1000).collect()}
    assert found == {i: (url, len(html)) for i, url, html in rows}


def test_warc_notices_damage(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame([(1, "u", "abcabc")], "page_id long, url string, html string"), path)
    broken = f"file://{tmp_path}/broken"
    spark.read.parquet(path).withColumn("data", F.encode(F.replace(F.decode("data", "utf-8"), F.lit("abcabc"), F.lit("abcabd")), "utf-8")).write.parquet(broken)
    with pytest.raises(Exception, match="isn't as recorded"):
        warc.read_archives(spark, broken).collect()
