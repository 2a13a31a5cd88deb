"""Mixing, language-model scores, the pipeline and the registered queries."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import assert_same, connection

from needledrop.llm import lm, mixing, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    assert_same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def brute_mix(rows, weights=(5, 2, 1), most=3, seed=17):
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    stopped: set = set()
    while True:
        left = sum(of.values()) - sum(most * of[s] for s in stopped)
        share = sum(weight[s] for s in sources if s not in stopped)
        target = {s: most * of[s] if s in stopped else left * weight[s] / share for s in sources} if share else {s: most * of[s] for s in sources}
        more = {s for s in sources if s not in stopped and target[s] >= most * of[s]}
        if not more:
            break
        stopped |= more
    out = []
    for s in sources:
        u = int(hashlib.md5(f"{seed}:{'' if s is None else '=' + s}".encode()).hexdigest()[:8], 16) / 2**32
        e = min(target[s] / of[s], most) if of[s] else 0.0
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (size(r[1]), r[0] is not None, r[0] or 0))
        out += [(r[0], size(r[1]), of[s], round(float(target[s]), 6), (math.floor((k + 1) * e + u) - math.floor(k * e + u)) * size(r[1])) for k, r in enumerate(mine)]
    return sorted(out, key=repr)


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "c", "d", "é", None][int(rng.choice(6, p=[0.4, 0.05, 0.02, 0.33, 0.1, 0.1]))]) for i in range(400)]
    rows += [(7, None, "a"), (None, "x y", "a"), (7, "same", "z"), (7, "same", "z"), (900, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as part", "'x' as target").repartition(7)
    out = mixing.mix_sources(df)
    found = sorted((((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])) for r in out.collect()), key=repr)
    assert found == brute_mix(rows)
    assert all(r["copies"] <= 3 for r in out.collect())
    emitted = Counter(r["doc_id"] for r in mixing.emit_mix(df).collect())
    want = Counter()
    for r in out.collect():
        want[r["doc_id"]] += r["copies"]
    assert emitted == +want
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.emit_mix(df).columns == df.columns


def test_taken_words_are_near_targets(spark, sf_dir):
    rows = queries.op1_mix_sources(spark, "/root/testdata/sf0.1").groupBy("target", "source_size").agg({"taken": "sum", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= max(2 * r["max(size)"], 0.05 * r["target"]) for r in rows)


def test_prefix_code_is_one():
    code = lm.Code(np.arange(256) ** 2)
    assert abs(sum(2.0 ** -int(n) for n in code.length) - 1) < 1e-12
    assert len({tuple(zip(code.nodes[s : s + n].tolist(), code.bits[s : s + n].tolist(), strict=True)) for s, n in zip(code.start, code.length, strict=True)}) == 256


def test_probabilities_of_a_byte_sum_to_one():
    rng = np.random.default_rng(0)
    code = lm.Code(rng.integers(0, 1000, 256))
    mixer = lm.Mixer(lm.ORDERS, lm.GATES, 255)
    mixer.weights = rng.normal(size=mixer.weights.shape)
    zeros, ones, gates = rng.integers(0, 9, (lm.ORDERS, 255)), rng.integers(0, 9, (lm.ORDERS, 255)), rng.integers(0, lm.GATES, 255)
    of, nodes, bit = code.decisions(np.arange(256, dtype=np.uint64))
    x = lm.evidence(zeros[:, nodes], ones[:, nodes])[0]
    prices = np.bincount(of, weights=mixer.log10(x, gates[nodes], nodes, bit))
    assert abs((10**prices).sum() - 1) < 1e-6


def test_counts_in_a_byte():
    n = np.array([*range(9), 100, 10_000, 10**9, 10**12])
    back = lm.unsqueeze(lm.squeeze(n))
    assert back[:9].tolist() == n[:9].tolist()
    assert (np.abs(back - n) <= 0.08 * n).all()


def plain_tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def brute_scores(rows, held):
    """The scores of lm.score with one bucket, one group and one learner: counts in dictionaries, decision after decision."""
    words, pairs, spelled, frequency = Counter(), Counter(), Counter(), np.zeros(256, dtype=np.int64)
    for (_, text), out in zip(rows, held, strict=True):
        tokens = plain_tokens(text)
        for a, w in () if out else zip([b"\n", *tokens[:-1]], tokens, strict=True):
            words[w] += 1
            pairs[a, w] += 1
            for byte in w if w == b"\n" else w + b" ":
                frequency[byte] += 1
    code = lm.Code(frequency)
    path = lambda byte: [(int(code.nodes[i]), int(code.bits[i])) for i in range(code.start[byte], code.start[byte] + code.length[byte])]
    contexts = lambda w, i: [(k, w[max(0, i - k) : i]) for k in range(1, 5)] + [("word", w[:i])]
    every = {w for _, text in rows for w in plain_tokens(text)}
    for w in every:
        letters = w if w == b"\n" else w + b" "
        for i, byte in enumerate(letters):
            for c in contexts(letters, i):
                for node, bit in path(byte):
                    spelled[c, node, bit] += words[w]
    about = lambda n: np.float32(lm.unsqueeze(lm.squeeze(np.array(n))))

    def of_word(w, without):
        x, gates, nodes, bits = [], [], [], []
        letters = w if w == b"\n" else w + b" "
        for i, byte in enumerate(letters):
            for node, bit in path(byte):
                two = [lm.evidence(np.maximum(about(spelled[c, node, 0]) - (bit == 0) * without, 0), np.maximum(about(spelled[c, node, 1]) - (bit == 1) * without, 0)) for c in contexts(letters, i)]
                x.append([float(a) for a, _ in two])
                gates.append(int(two[4][1]) * 4 + min(int(two[3][1]), 3))
                nodes.append(node)
                bits.append(bit)
        return np.array(x, dtype=np.float32).T, np.array(gates), np.array(nodes), np.array(bits)

    ordered = sorted(every, key=lambda w: int(lm.hashes_of([b"" if w == b"\n" else w])[0]))
    mixer = lm.Mixer(lm.ORDERS, lm.GATES, 255)
    taught = [(of_word(w, np.float32(1)), words[w]) for w in ordered if words[w]]
    x, gates, nodes, bits = (np.concatenate([t[k] for t, _ in taught], axis=-1) for k in range(4))
    mixer.learn(x, gates, nodes, bits, np.concatenate([np.full(len(t[3]), c, dtype=float) for t, c in taught]))
    price = lambda w, without: mixer.log10(*of_word(w, np.float32(without))).sum()
    out = []
    for (_, text), own in zip(rows, held, strict=True):
        tokens, rest, features = plain_tokens(text), 0.0, []
        for a, w in zip([b"\n", *tokens[:-1]], tokens, strict=True):
            followed, followers = pairs[a, w] - (not own), max(words[a] - (not own), 0)
            rest += math.log10(followed / followers) if followed > 0 else price(w, 0 if own or not words[w] else 1)
            features.append((int(followed > 0), followers.bit_length()))
        out.append((rest, features))
    return out


def test_scores_against_brute_force(spark):
    """Everything up to the decisions about pairs, and these from plain counts."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 7)))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30))))) for i in range(120)]
    rows += [(1000 + i, rows[i][1]) for i in range(25)] + [(2000, None), (2001, "newword Abc")]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    found = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_scores(rows, held)
    # The decisions about pairs.
    counts = [Counter() for _ in range(4)]
    seen = []
    for _, features in want:
        past, mine = [], []
        for k, (bit, level) in enumerate(features):
            last = lambda n: sum(b << i for i, b in enumerate(reversed(past[-n:])))  # noqa: E731, B023
            four = (level * 8 + last(3), last(12), level * 64 + (features[k - 1][1] if k else 0), sum(past[-16:]) * 2 + last(1))
            mine.append((four, sum(past[-8:]), bit))
            past.append(bit)
        seen.append(mine)
    for mine, own in zip(seen, held, strict=True):
        for four, _, bit in () if own else mine:
            for c, place in zip(counts, four, strict=True):
                c[place, bit] += 1
    flat = [np.array([[c[p, 0], c[p, 1]] for p in range(n)]) for c, n in zip(counts, lm.PAIR_SIZES, strict=True)]
    table = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), bucket_bytes=300, group_bytes=200).collect()}
    for (i, _), (rest, _), mine in zip(rows, want, seen, strict=True):
        # A mixer's price of the pairs lies between the surest and the least sure that its predictors allow; exactly, its bits
        # are what is left of the score.
        left = found[i]["score"] - rest
        assert -6.0 * len(mine) <= left < 0
        assert math.isclose(found[i]["n_tokens"], len(mine))
        assert table[i]["n_tokens"] == found[i]["n_tokens"]
    bit = np.array([b for m in seen for _, _, b in m])
    at = np.array([f for m in seen for f, _, _ in m]).T
    lengths = np.array([len(m) for m in seen])
    level = np.array([lv for _, features in want for _, lv in features])
    made, gate = lm.pair_contexts(bit, level, lengths)
    assert (made == at).all() and gate.tolist() == [g for m in seen for _, g, _ in m]
    assert all(t.sum() == sum(n for n, own in zip(lengths.tolist(), held, strict=True) if not own) for t in flat)
    # With the tables counted here and the model's own mixer, the scores are the model's.
    spread = spark.createDataFrame([(i, bool(own), bytes(lv << 1 | b for b, lv in features)) for (i, _), own, (_, features) in zip(rows, held, want, strict=True)], "doc_id long, held_out boolean, pairs binary")
    tables, mixer = lm.pair_model(spread, 1)
    assert all((a == b).all() for a, b in zip(tables, flat, strict=True))
    without = np.repeat(~np.array(held), lengths).astype(np.int32)
    prices = np.add.reduceat(mixer.log10(lm.pair_inputs(flat, at, bit, without), gate, gate, bit), np.cumsum(lengths) - lengths)
    for (i, _), (rest, _), price in zip(rows, want, prices.tolist(), strict=True):
        assert math.isclose(found[i]["score"], rest + price, rel_tol=1e-3, abs_tol=1e-3)


def test_scores(spark, sf_dir):
    extra = [(9_000_000, None), (9_000_001, ""), (None, "no id"), (9_000_002, "ÄB cD")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 as g", "'x' as held_out", "'y' as pairs")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert set(rows) == set(texts)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    c = Counter(w for i, words in tokens.items() if not held[i] for w in words)
    n, v = sum(c.values()), len(c)
    for i, words in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words), sum(w in c for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
        assert r["score"] < 0
    # Held-out accuracy: far fewer bits than eight a byte, and than the bytes' own entropy.
    some = [rows[i] for i in texts if held[i] and len(tokens[i]) > 20]
    bits = sum(r["bits_per_byte"] * r["n_bytes"] for r in some) / sum(r["n_bytes"] for r in some)
    counts = np.array([*Counter(b"".join(b" ".join(tokens[i][:-1]) + b"\n" for i in texts if held[i])).values()])
    assert bits < 0.75 * -(counts / counts.sum() * np.log2(counts / counts.sum())).sum()
    assert lm.score(docs.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small = dict(bucket_bytes=40_000, group_bytes=60_000)
    one, many = ({r["doc_id"]: r["score"] for r in lm.score(docs.repartition(n), **small).collect()} for n in (1, 9))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


def test_texts_that_occur_twice_stand_out(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in range(40)]
    texts = [" ".join(rng.choice(vocabulary, 80)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(20)]
    out = {r["doc_id"]: (r["held_out"], r["bits_per_byte"]) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    both = [out[i][1] for i in range(20) if not out[i][0] and not out[1000 + i][0]]
    assert len(both) > 10 and max(both) < min(b for i, (_, b) in out.items() if 20 <= i < 1000)


def test_pipeline(spark, sf_dir):
    """run() against the same decisions made row by row."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from needledrop.llm import fertility
    from test_near_copies import brute_groups

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "repeated passages", "mixture", "tokens"]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"] for r in fertility.measure(table).where("kept").collect()}
    docs = {r["doc_id"]: r for r in table.collect() if r["doc_id"] in good}
    ids = sorted(docs)
    component = brute_groups({i: docs[i]["text"] for i in ids})
    ids = [i for i in ids if component[i] == i]
    first: dict = {}
    for i in ids:
        words = docs[i]["text"].encode().split()
        for p in range(len(words) - 49):
            first.setdefault(tuple(words[p : p + 50]), i)
    kept = []
    for i in ids:
        words = docs[i]["text"].encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - 49):
            if first[tuple(words[p : p + 50])] != i:
                gone[p : p + 50] = [True] * 50
        left = [w for w, g in zip(words, gone, strict=True) if not g]
        if left:
            kept.append((i, b" ".join(left).decode() if any(gone) else docs[i]["text"], docs[i]["source"]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    texts = {i: t for i, t, _ in kept}
    for i, size, _, _, taken in brute_mix(kept):
        ids_ = library.encode(texts[i], add_special_tokens=False).ids
        want[(i, len(ids_), hashlib.sha256(",".join(map(str, ids_)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())] += taken // size
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == +want
