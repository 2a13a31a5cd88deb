"""Golden tables: profiles, grades, decisions, card boundaries; and the shape of plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from needledrop.functions import decision, grading, paths, text
from needledrop.operators import catalog, signal
from needledrop.plans import planning
from needledrop.sources.bind import albums


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").orderBy("_i").select(*columns).collect()]


def test_profiles(spark):
    cases = {
        "44100/16": "44100/16", "44.1/16": "44100/16", "44.1-16": "44100/16", "44k/16": "44000/16", "44khz/16": "44000/16", "48/24": "48000/24",
        "96-24": "96000/24", "96_24": "96000/24", "176.4/24": "176400/24", " 96k/24 ": "96000/24", "48/32f": "48000/32f",
        "": None, "abc": None, "44.1": None, "44//16": None, "foo-24": None, "0/16": None,
    }
    assert values(spark, [(k,) for k in cases], "raw string", text.canonical_profile(F.col("raw"))) == [(v,) for v in cases.values()]


@pytest.mark.parametrize(("profile", "bounds"), [("standard", (12, 9, 7, 5)), ("audiophile", (14, 12, 9, 6)), ("high_energy", (11, 9, 7, 4)), ("unknown", (12, 9, 7, 5))])
def test_grades(spark, profile, bounds):
    rows = [(float(b) - e,) for b in bounds for e in (0.0, 0.1)]
    want = [(g,) for i, s in enumerate("SABC") for g in (s, "SABCF"[i + 1])]
    assert values(spark, rows, "dr double", grading.grade(F.col("dr"), F.lit(profile))) == want


def test_decisions(spark):
    unsure = ("low", "fallback_due_to_disagreement")
    rows = [
        (21750, 48000, None, None, 48000, False, 48000), (18000, 48000, None, None, 44100, True, 44100), (20000, 96000, None, None, 44100, True, 44100),
        (23000, 96000, None, None, 48000, True, 48000), (43000, 176400, None, None, 44100, True, 88200), (70000, 384000, None, None, 48000, True, 192000),
        (70000, 192000, None, None, 48000, False, 192000), (29898, 192000, "high", None, 48000, False, 192000), (4738, 192000, *unsure, 48000, False, 192000),
        (4738, 384000, *unsure, 48000, False, 192000), (4738, 705600, *unsure, 44100, False, 176400), (None, 2822400, None, None, None, False, 176400),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, cutoff int, sr int, confidence string, reason string")
    found = decision.decided(df, F.col("cutoff"), F.col("sr"), F.col("confidence"), F.col("reason"), F.lit(None).cast("boolean")).orderBy("i")
    assert [tuple(r) for r in found.select("standard_family", "fake_upscale", "target_sr").collect()] == [r[4:] for r in rows]


def test_advice(spark):
    cases = [
        ("96000/24", "48000/24", False, "", "Recode to 48000/24"), ("48000/24", "48000/24", False, "", "Keep as-is"), ("48000/24", "48000/16", False, "", "Recode to 48000/16"),
        ("48000/32f", "48000/16", False, "", "Keep as-is"), ("48000/24", "44100/16", False, "96000/24", "Keep as-is"), (None, "44100/16", True, "", "Recode to 44100/16"), ("48000/24", "bad", True, "", "Keep as-is"),
    ]
    advice = decision.recode_advice(F.col("s"), F.col("t"), F.col("f"), F.col("p"))
    assert values(spark, [c[:4] for c in cases], "s string, t string, f boolean, p string", advice["text"]) == [(c[4],) for c in cases]


def test_genres_disagree(spark):
    rows = [("Ambient",), ("Classic Rock",), ("Ambient;Electronic;Rock",), ("",)]
    found = values(spark, rows, "tag string", grading.tag_profile(F.col("tag")), grading.voted_profile(F.array("tag")))
    assert found == [("standard", "audiophile"), ("high_energy", "audiophile"), ("high_energy", "audiophile"), ("standard", "standard")]


def test_marks_and_names(spark):
    assert values(spark, [("01:02:37",), ("1:60:00",), (None,)], "m string", paths.index_seconds(F.col("m"))) == [(62.493333,), (None,), (None,)]
    assert values(spark, [("Last, First",), ("One Two",)], "n string", paths.unsorted_name(F.col("n"))) == [("First Last",), ("One Two",)]
    assert values(spark, [("[00:01] a\n\n [x]\nb",)], "t string", paths.plain_lyrics(F.col("t"))) == [(" a\nb",)]
    assert paths.selected("2,4,9-7,a1,0,99", 10) == [2, 4, 9, 8, 7]
    assert paths.selected("all", 3) == [1, 2, 3]


def test_search_tokens():
    assert catalog.query_tokens("Orwell 19 84 b 7") == ["orwell", "1984", "b", "7"]


def test_bands(spark):
    rows = [(21.8, 96.0), (96.0, 96.0), (19.4, 22.0), (44.18, 48.0), (16.5, 96.0), (10.0, 22.0)]
    want = ["cd-or-48k", "hires-192-class", "cd-or-48k", "hires-96-class", "low-bandwidth", "low-bandwidth"]
    assert [r[0] for r in values(spark, rows, "c double, t double", planning.band_class(F.col("c"), F.col("t")))] == want


def test_spectrum_finds_a_tone(spark):
    import math

    tone = [[math.sin(2 * math.pi * b * i / 64) for i in range(64)] for b in (4, 16, 28)]
    df = spark.createDataFrame(list(enumerate(tone)), "id long, samples array<double>")
    found = {r["id"]: r["cutoff_bin"] for r in signal.spectra(df, threshold=-20.0).collect()}
    assert all(abs(found[i] - b) <= 2 for i, b in enumerate((4, 16, 28)))
    assert {r["id"]: r["cutoff_bin"] for r in signal.fft_cutoffs(df, threshold=-20.0).collect()} == found


def test_page_is_a_heap_not_a_sort(spark, sf_dir):
    plan = catalog.page(albums(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_empty_catalog(spark, sf_dir):
    none = albums(spark, sf_dir).where("id < 0")
    assert [tuple(r) for r in catalog.inventory(none, "codec_norm").collect()] == [("__all__", 0)]
    assert catalog.stats(none, none).first()["total"] == 0
    assert catalog.page(none).count() == 0


def test_calibrated_verdicts(spark):
    schema = "id int, cutoff double, top double, transition boolean, stats boolean, peak double, dr double, span double, ratio double, brickwall boolean"
    cases = [
        ((96.0, 96.0, True, True, -3.0, 15.0, 34.0, 0.5, False), ("192000/24", "S", "HIGH", "hires-192-class")),
        ((21.8, 96.0, True, False, None, None, 18.0, 0.18, True), ("lossy-upsampled", "F", "MEDIUM", "cd-or-48k")),
        ((19.4, 22.0, True, False, None, None, 18.0, 0.82, False), ("44100/16", "C", "MEDIUM", "cd-or-48k")),
        ((20.3, 22.05, True, False, None, None, 24.0, 0.0, False), ("44100/16", "C", "MEDIUM", "cd-or-48k")),
        ((22.1, 24.0, True, False, None, None, 24.0, 0.0, False), ("48000/24", "C", "MEDIUM", "cd-or-48k")),
        ((44.18, 48.0, True, False, None, None, 22.37, 1.4, False), ("96000/24", "B", "MEDIUM", "hires-96-class")),
        ((16.5, 96.0, True, True, -0.3, 6.0, 15.0, 0.12, False), ("lossy-compressed", "F", "LOW", "low-bandwidth")),
        ((22.4, 48.0, True, False, None, None, 34.0, 0.9, False), ("96000/24", "B", "MEDIUM", "hires-96-class")),
        ((22.4, 48.0, True, False, None, None, 18.0, 0.2, False), ("44100/16", "C", "MEDIUM", "cd-or-48k")),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], schema)
    found = {r["id"]: (r["label"], r["class"], r["profile_confidence"], r["band"]) for r in planning.verdict(df).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}


def test_lyrics_of_every_song_outside_the_cache(spark, sf_dir):
    """Against brute force: all tracks that aren't in the cache are looked up and upserted, not first tracks alone."""
    from needledrop.operators import maintenance_queries as m

    wanted, cache = (x.collect() for x in m._songs(spark, sf_dir))
    ids = {r["song_id"] for r in wanted}
    assert len(ids) + len(cache) == m.tracks(spark, sf_dir).count()
    assert not ids & {r["cache_id"] for r in cache} and len({i % 100 for i in ids}) > 1
    by: dict = {}
    for c in cache:
        by.setdefault((c["artist_lc"], c["title_lc"]), []).append(c)
    best = {}
    for w in wanted:
        near = [(c["updated_at"], c["cache_id"], c["status"]) for c in by.get((w["artist_lc"], w["title_lc"]), []) if max(w["duration_int"] - 2, 0) <= c["duration_int"] <= w["duration_int"] + 2]
        if near:
            best[w["song_id"]] = max(near)
    assert {r["song_id"]: (r["updated_at"], r["cache_id"], r["status"]) for r in m.QUERIES["lyrics_asof_all"](spark, sf_dir).collect()} == best
    assert ids <= {r["cache_id"] for r in m.QUERIES["lyrics_window_upsert_all"](spark, sf_dir).collect()}


def test_golden_profiles(spark):
    """Spellings and what they mean, as literal rows."""
    from needledrop.functions import text

    rows = [
        ("44.1/16", "44100/16"), ("44100/16", "44100/16"), ("44k/16", "44000/16"), ("48khz-24bit", "48000/24"), ("96000hz:24b", "96000/24"), ("96_24", "96000/24"), ("4410016", "44100/16"),
        ("192000/32f", "192000/32f"), ("192/fltp", "192000/32f"), ("96/dblp", "96000/64f"), ("48/float", None), ("96/0", None), ("0/24", None), ("44.1", None), ("abc", None), ("", None),
        (" 176.4 / 24 ", "176400/24"), ("48/1024", None), ("88.2/024", "88200/24"), (None, None),
    ]
    found = spark.createDataFrame(rows, "raw string, want string").select("raw", "want", text.canonical_profile("raw").alias("got")).collect()
    assert [r for r in found if r["got"] != r["want"]] == []


def test_pages_derive_after_the_top_k(spark, sf_dir):
    """The default view sorts by stored columns: no grade, profile or codec is worked out below the top-k heap."""
    from needledrop.operators import catalog
    from needledrop.sources.bind import albums

    plan = catalog.page(albums(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("TakeOrderedAndProject") :].split("\n", 1)[1]
    assert "RLIKE" not in below and "regexp" not in below and "exists(" not in below


def test_search_without_marks(spark):
    from needledrop.operators import catalog

    rows = [(1, "Björk", "Début"), (2, "AC-DC", "High Voltage"), (3, "ACME", "DC live"), (4, "Sigur Rós", "Von")]
    df = spark.createDataFrame(rows, "id int, artist string, album string")
    hits = lambda q: sorted(r["id"] for r in df.where(catalog.token_hit(catalog.query_tokens(q))).collect())
    assert (hits("bjork deb"), hits("BJÖRK"), hits("ac-d"), hits("dc-l"), hits("ros vo"), hits("ork")) == ([1], [1], [2], [3], [4], [])


def test_stream_goes_on_where_it_was(spark, tmp_path):
    """A second call with the same home takes the new file alone, and gives the last items of both."""
    import datetime as dt

    from needledrop.streaming import queue

    def put(rows):
        made = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h), u, t) for i, h, u, t in rows], queue.ITEMS)
        made.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    home = f"file://{tmp_path}/home"
    call = lambda: {r["key"]: (r["kind"], r["item"]) for r in queue.stream_latest(spark, f"file://{tmp_path}/in", "*.parquet", home).collect()}
    put([(1, 1, 7, "signup"), (2, 2, 7, "click"), (3, 1, 8, "signup")])
    assert call() == {7: ("changed", 2), 8: ("new", 3)}
    put([(4, 5, 8, "click"), (5, 1, 9, "signup")])
    assert call() == {7: ("changed", 2), 8: ("changed", 4), 9: ("new", 5)}
    batches = spark.read.parquet(f"{home}/table").select("batch", "item").collect()
    assert sorted(map(tuple, batches)) == [(0, 2), (0, 3), (1, 4), (1, 5)]
