"""Work that must not grow with the square of a group, and results that differed from SQL on larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from needledrop.operators import files


def joined_rows(df) -> int:
    """The most rows that a join of df's plan made."""
    df.collect()

    def walk(plan) -> int:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        return max([own, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_sources_of_one_album_and_year(spark):
    """rows of one album and year meet one row of each rank, not each other."""
    rows = spark.range(2000).select("id", F.concat(F.lit("a"), (F.col("id") % 700).cast("string")).alias("artist"), F.lit("X").alias("album"), F.lit(1999).alias("year_int"))
    have = rows.withColumn("source_path", F.when(F.col("id") % 5 > 1, F.concat(F.lit("/p/"), F.col("id").cast("string"))))
    found = files.source_rows(rows, have)
    assert joined_rows(found) <= 2000
    out = {r["id"]: (r["source_id"], r["source_path"]) for r in found.collect()}
    with_path = [i for i in range(2000) if i % 5 > 1]
    same = {a: min(i for i in with_path if i % 700 == a) for a in range(700) if any(i % 700 == a for i in with_path)}
    want = {i: i if i % 5 > 1 else same.get(i % 700, with_path[0]) for i in range(2000)}
    assert out == {i: (s, f"/p/{s}") for i, s in want.items()}


def test_quantiles_round_as_sql_does(spark):
    """a 75th percentile and a product-sum have SQL's last bit."""
    import math
    import random

    import duckdb

    from needledrop.operators import spectrogram, strategy

    rng = random.Random(3)
    values = [[rng.randrange(97) * 0.03 for _ in range(6)] for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, values array<double>")
    got = [r["x"] for r in df.select("i", strategy.row_energy(F.col("values"), "intensity").alias("x")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT list_aggregate(?::DOUBLE[], 'quantile_cont', 0.75)", [v]).fetchone()[0] for v in values]
    triples = [(rng.uniform(0, 99), rng.uniform(0, 99), rng.random()) for _ in range(500)]
    mixed = spark.createDataFrame(triples, "a double, b double, p double").select("*", spectrogram.between(F.col("a"), F.col("b"), F.col("p")).alias("x")).collect()
    assert all(r["x"] == math.fma(r["a"], 1 - r["p"], r["b"] * r["p"]) for r in mixed)


def test_titles_have_runs(spark, sf_dir):
    """the next run every 35 minutes, an even moment being its own."""
    from needledrop.functions import media_queries

    runs = {r["id"] % 1440: r["run"] for r in media_queries.QUERIES["titles_and_runs"](spark, sf_dir).collect()}
    assert all(runs[k] == want for k, want in {0: "00:00", 1: "00:35", 35: "00:35", 36: "01:10", 1439: "00:30"}.items() if k in runs)


def test_last_page_comes_from_the_end(spark, sf_dir):
    """the last page takes as many rows as it has, not all before it."""
    import re

    from needledrop.operators import catalog
    from needledrop.sources.bind import albums

    rows = albums(spark, sf_dir)
    page = catalog.nearest_page(rows, "grade_first", 10**6)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert max(int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)) <= 15
    total = catalog.page_count(rows, "grade_first")
    whole = [r["id"] for r in catalog.display(catalog.graded(rows.where("rarity = 0")).orderBy(*catalog.order("grade", False))).collect()]
    for number in (1, 2, total // 2, total // 2 + 1, total - 1, total, total + 5):
        at = (min(number, total) - 1) * 15
        assert [r["id"] for r in catalog.nearest_page(rows, "grade_first", number).collect()] == whole[at : at + 15]


def test_songs_meet_one_length(spark):
    """a song meets one row of the cache, whatever the number of lengths of its title."""
    from needledrop.operators import maintenance

    songs = spark.range(600).select(F.col("id").alias("song_id"), F.lit("a").alias("artist_lc"), F.lit("t").alias("title_lc"), F.col("id").cast("int").alias("duration_int"))
    cache = songs.where("song_id % 3 = 0").select("artist_lc", "title_lc", "duration_int", F.col("song_id").alias("cache_id"), (F.col("song_id") * 7 % 11).alias("updated_at"), F.lit("found").alias("status"))
    found = maintenance.lyrics_lookup(songs, cache)
    assert joined_rows(found) <= 600
    best = {i: max((c * 7 % 11, c) for c in range(0, 600, 3) if max(i - 2, 0) <= c <= i + 2) for i in range(600)}
    assert {r["song_id"]: (r["updated_at"], r["cache_id"]) for r in found.collect()} == best


def test_grades_are_worked_out_once(spark, sf_dir):
    """the plan of graded albums has each step of a profile, a grade and a rank once, not once for each use."""
    from needledrop.operators import catalog
    from needledrop.sources.bind import albums

    plan = catalog.graded(albums(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 1
    assert plan.count("try_cast(regexp_extract(") <= 2


def test_profiles_in_any_spelling(spark):
    """the same profiles as before."""
    from needledrop.functions import text

    given = {"44.1/16": "44100/16", "96-24": "96000/24", "48k/24": "48000/24", "192000/32f": "192000/32f", "4410016": "44100/16", "44.1kHz 24bit": None, "mixed": None, "": None, None: None, "0/16": None, "44100hz:dblp": "44100/64f", "44.1k_1000": None}
    out = {r["p"]: r["x"] for r in spark.createDataFrame([(p,) for p in given], "p string").select("p", text.canonical_profile(F.col("p")).alias("x")).collect()}
    assert out == given


def test_lines_are_matched_once(spark, sf_dir):
    """F8: the plan has each pattern of a track's line once for its number and once for its name, and not in a filter again."""
    from needledrop.functions import parsing_queries

    plan = parsing_queries.QUERIES["report_tracks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 6


def test_lines_of_reports(spark):
    """F8: of each kind of line the first pattern that matches counts, with number and name."""
    from needledrop.functions import parsing

    lines = ["  1. One:  DR 7.5 ", "DR8  -0.10 dB  -12.30 dB  3:45 /x/Two [flac] ", "DR9 a b 3:45  Three.flac", "DR x", "Total DR: DR5", "12. DR", "\tDR10 a b Four\n", "x DR3 a b c", "", None]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "report int, line_no int, text string")
    assert {(r["name"], r["dr"]) for r in parsing.report_tracks(rows).collect()} == {("1. One", 7.5), ("Two", 8.0), ("Three.flac", 9.0), ("Four", 10.0)}
    assert [(r["total"]) for r in parsing.report_totals(rows).collect()] == [5.0]


def test_names_meet_by_hash(spark, sf_dir):
    """known forms are gathered without a sort, and graded names derive the tracks once for each use of a side."""
    import re

    from needledrop.functions import parsing_queries

    plan = lambda name: parsing_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSortAggregate\b", plan("fuzzy_track_match"))) <= 2  # the choice among parts
    assert len(re.findall(r"\bWindow \[", plan("track_dr_grades"))) <= 8


def test_quality_counts_tokens_only_where_bounds_leave_it_open():
    """The verdict is that of all counts; prose that its bounds decide costs no count; bounds hold for odd words."""
    import random

    import numpy as np

    from needledrop.llm import fertility

    random.seed(4)
    made = lambda n: " ".join("".join(random.choice("etaoinshr") for _ in range(random.randrange(2, 9))) for _ in range(n))
    odd = " ".join(["o'sx", "don't", "x<|endoftext|>y", "café", " a　b", "a1b2", "言葉", "'", "Q" * 90, "...,,,"] * 9)
    texts = ["", "  \n", "a b " * 60, odd, *(made(n) for n in (40, 60, 300)), "zq xj vk qz " * 3 + made(200), "z9#q " * 70 + made(60), " ".join(chr(97 + i % 26) + chr(97 + i * 7 % 26) for i in range(400))]
    store = fertility.Fertility("byte_bpe_50k.json", "piece_bpe_32k.model")
    flat, ends = store.numbers(texts)
    assert [b - a for a, b in zip(ends[:-1], ends[1:])] == [len(t.encode().split()) for t in texts]
    bounds = store.tokens.copy(), store.tokens_most.copy()
    rows = [(t, lang, flat[a:b]) for t, a, b in zip(texts, ends[:-1], ends[1:]) for lang in ("en", "ru", None)]
    lazy = [fertility.keeps(store, *r) for r in rows]
    store.count(flat)
    assert lazy == [fertility.judge(store, *r)[6] for r in rows]
    assert (bounds[0] <= store.tokens).all() and (store.tokens <= bounds[1]).all() and (store.tokens == store.tokens_most).all()
    plain = [len(e.ids) for e in store.byte_level.encode_batch([" " + w for w in store.words], add_special_tokens=False)]
    assert store.tokens.tolist() == plain
    # Words that all are known but for some: no count is needed.
    prose = " ".join(w for w in ["the people of this country have been there before"] * 12) + " " + made(4)
    fresh = fertility.Fertility("byte_bpe_50k.json", "piece_bpe_32k.model")
    fresh.count(fresh.numbers(["the people of this country have been there before"])[0])
    numbers, _ = fresh.numbers([prose])
    fertility.keeps(fresh, prose, "en", np.concatenate((numbers[:9], numbers[-4:], numbers[:45])))
    assert (fresh.tokens < fresh.tokens_most).sum() == 4


def test_names_meet_by_group_after_one_shuffle(spark):
    """Names of all kinds as by the rule, name by name; only names are shuffled, not their forms, and no join goes by ids."""
    import random

    from pyspark.sql import functions as F

    from needledrop.functions import parsing

    random.seed(6)
    some = ["a", "Bé", "ﬁ", "7", "01 - ", "1:02 ", ".flac", " ", "\t", "[x]", " [flac]", "/", "_", "12. ", "\x1f", "ß", "　", "live"]
    made = lambda n, last: [(i, None if i % 97 == 0 else i % 40, None if i % 50 == 7 else "".join(random.choices(some, k=random.randrange(6))), random.choice(last)) for i in range(n)]
    w, k = made(600, ["standard", "odd", None]), made(500, ["7", "8.5", "n/a", None])
    forms = [(i, n, parsing.plain_aliases(n)) for i, _, n, _ in w + k]
    rows = spark.createDataFrame([(j, x[1]) for j, x in enumerate(forms)], "j int, name string").withColumn("odd_forms", parsing.odd_aliases(F.col("name")))
    assert {r["j"]: r["forms"] for r in parsing.with_aliases(rows).collect()} == {j: x[2] for j, x in enumerate(forms)}

    def best(g, name, known):
        """The known id and how it was found."""
        at = {}
        for i, h, n, _ in known:
            if h == g and g is not None:
                for turn, form in enumerate(parsing.plain_aliases(n)):
                    first, last = at.get(form, ((i, turn), i))
                    at[form] = min(first, (i, turn)), max(last, i)
        mine = parsing.plain_aliases(name)
        same = [at[a][1] for a in mine if a in at]
        part = sorted((t, *at[f][0], at[f][1]) for t, a in enumerate(mine) for f in at if f in a or a in f)
        return (same[0], "alias") if same else (part[0][-1], "part") if part else None

    wanted = spark.createDataFrame(w, "wanted_id long, group long, name string, profile string")
    known = spark.createDataFrame(k, "known_id long, group long, name string, dr string")
    found = {r["wanted_id"]: (r["known_id"], r["by"]) for r in parsing.match_names(wanted, known).collect()}
    assert found == {i: b for i, g, n, _ in w if (b := best(g, n, k))} and {b for _, b in found.values()} == {"alias", "part"}
    numbers = [r for r in k if r[3] in ("7", "8.5")]
    dr_of = {i: dr for i, _, _, dr in numbers}
    assert {r["wanted_id"]: r["dr"] for r in parsing.graded_names(wanted, known).collect()} == {i: dr_of[b[0]] if (b := best(g, n, numbers)) else "N/A" for i, g, n, _ in w}
    for df in (parsing.match_names(wanted, known), parsing.graded_names(wanted, known)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_signature_takes_ties_and_rounds_as_sql_does(spark):
    """A mean that equals the threshold counts, whatever its sum's last bit; sixth decimals are rounded as the SQL engine has it."""
    import numpy as np
    from pyspark.sql import functions as F

    from needledrop.operators import spectrogram
    from needledrop.operators.spectrogram_queries import _six

    e = np.zeros(150)
    e[24:] = np.random.default_rng(4).integers(0, 4, 126) + (np.arange(24, 150) > 60)
    rows = spark.createDataFrame([(1, i, float(x), 48.0) for i, x in enumerate(e)], "image int, row long, energy double, max_khz double")
    found = spectrogram.signature(rows).first()
    assert found["threshold"] == 2.0 and found["cutoff_row"] == 22  # 48 thirds over 8 rows; summed one by one 1.9999999999999998
    some = spark.createDataFrame([(19.318437499999998,), (19.819187499999998,), (0.1234564,), (-2.5e-6,), (None,)], "x double").select(_six(F.col("x")).alias("y"))
    assert [r["y"] for r in some.collect()] == [19.318438, 19.819188, 0.123456, -3e-6, None]
