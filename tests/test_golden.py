"""Rules as they were first written down: what must come out for given cases, stated as literals."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from needledrop.functions import media, parsing, paths, routing, sizes, text, years
from needledrop.operators import catalog, files, fingerprints, logs, maintenance, mutations, reports, signal, strategy, transfer
from needledrop.operators.files import pcm_bytes
from needledrop.plans import planning


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


ALBUM = "id long, artist string, album string, year_int int, codec string, bitrate string, current_quality string, genre_tag string, dynamic_range_score double, rarity int, scan_failed int, needs_recode int, needs_replacement int, has_lyrics int, last_recoded_at long, last_checked_at long, recode_recommendation string, notes string, source_path string"


def album(**given):
    row = dict.fromkeys(c.split()[0] for c in ALBUM.split(", ")) | {"id": 1, "artist": "A", "album": "B", "year_int": 1999, "rarity": 0, "scan_failed": 0, "needs_recode": 0, "needs_replacement": 0, "has_lyrics": 0} | given
    return tuple(row.values())


def test_cells_of_a_page(spark):
    rows = [
        album(id=1, codec=" FLAC ", bitrate="", current_quality="44.1/16", dynamic_range_score=12.0, last_recoded_at=5, has_lyrics=1, last_checked_at=86_400),
        album(id=2, year_int=0, codec="", bitrate="900k", current_quality="mixed", dynamic_range_score=7.25, scan_failed=1, notes="", recode_recommendation="Replace", last_recoded_at=0, last_checked_at=0),
        album(id=3, scan_failed=1, notes="probe failed", recode_recommendation="Replace"),
        album(id=4, scan_failed=0, notes="probe failed", recode_recommendation=""),
    ]
    found = {r["id"]: tuple(r)[1:] for r in catalog.display(catalog.graded(spark.createDataFrame(rows, ALBUM))).collect()}
    assert found == {
        1: ("A", "B**", "1999", "S", "12", " FLAC ", "-", "44.1/16", "-", "-", "1970-01-02 00:00"),
        2: ("A", "B", "-", "B", "7.3", "-", "900k", "mixed", "Replace", "Y", "-"),
        3: ("A", "B", "1999", "-", "-", "-", "-", "-", "probe failed", "Y", "-"),
        4: ("A", "B", "1999", "-", "-", "-", "-", "-", "-", "-", "-"),
    }


def test_an_upsert_keeps_what_a_scan_did_not_find(spark):
    names = (*maintenance.KEY, *maintenance.OVERWRITE, *maintenance.KEEP_IF_NULL, *maintenance.UNTOUCHED)
    numbers = {"year_int": 1999, "quality_score": 7, "needs_recode": 1, "needs_replacement": 1, "last_checked_at": 10, "scan_failed": 1, "grade_rank": 4, "dynamic_range_score": 12, "is_upscaled": 1, "rarity": 1, "has_lyrics": 1, "last_recoded_at": 3}
    schema = ", ".join(f"{c} {'int' if c in numbers else 'string'}" for c in names)
    old = {c: numbers.get(c, f"old {c}") for c in names} | {"artist_lc": "a", "album_lc": "b"}
    empty = dict.fromkeys(names) | {"artist_lc": "a", "album_lc": "b", "year_int": 1999, "artist": "A", "album": "B", "needs_recode": 0, "needs_replacement": 0, "last_checked_at": 20, "scan_failed": 0, "notes": ""}
    df = lambda *rows: spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    found = maintenance.upsert(df(old), df(empty)).collect()
    assert len(found) == 1
    changed = {"artist", "album", "quality_score", "needs_recode", "needs_replacement", "last_checked_at", "scan_failed", "notes"}
    assert {c for c in names if found[0][c] != old[c]} == changed
    assert found[0]["dynamic_range_score"] == 12 and found[0]["quality_score"] is None
    fresh = maintenance.upsert(df(old | {"album_lc": "other"}), df(empty)).where("album_lc = 'b'").first()
    assert (fresh["rarity"], fresh["has_lyrics"], fresh["last_recoded_at"]) == (0, 0, None)


def test_after_a_recode_an_album_waits_for_its_rescan(spark):
    a = spark.createDataFrame([album(id=1, needs_recode=1, scan_failed=1, current_quality="96000/24", last_checked_at=9, source_path="/x"), album(id=2, artist="Z")], ALBUM).withColumn("recode_source_profile", F.lit("old"))
    queue = spark.createDataFrame([("A", "a", "B", "b", 1999, "/gone", 1, "new", 1), ("Q", "q", "Q", "q", 0, "/q", 1, "new", 1)], "artist string, artist_lc string, album string, album_lc string, year_int int, source_path string, album_mtime long, scan_kind string, enqueued_at long")
    rows, waiting = mutations.recoded(a, queue, a.where("id = 1").select("id"), 1000)
    r = {x["id"]: x for x in rows.collect()}
    assert [r[1][c] for c in ("needs_recode", "recode_recommendation", "recode_source_profile", "last_checked_at", "scan_failed", "last_recoded_at")] == [0, "Pending rescan", "96000/24", 0, 0, 1000]
    assert (r[2]["recode_source_profile"], r[2]["last_recoded_at"]) == ("old", None)
    assert sorted(tuple(x) for x in waiting.select(queue.columns).collect()) == [("A", "a", "B", "b", 1999, "/x", 1000, "changed", 1000), ("Q", "q", "Q", "q", 0, "/q", 1, "new", 1)]


@pytest.mark.parametrize(("query", "ids"), [("!!!", []), ("- #", [2]), ("#", [2]), ("one !!!", []), ("19 84", [3]), ("on", [1, 4]), ("ac-dc", [4])])
def test_searches(spark, query, ids):
    rows = [album(id=1, artist="One"), album(id=2, artist="Five - # six"), album(id=3, artist="Orwell", album="1984"), album(id=4, artist="AC/DC", album="on")]
    assert sorted(r["id"] for r in catalog.search(spark.createDataFrame(rows, ALBUM), query).collect()) == ids


def test_years_of_releases(spark):
    for key in ("original_year_release", "ORIGINALYEAR", "TAG:Original Date", "tag:tory", "TAG:TDOR", "originalreleaseyear", "original-release", "my original mix year"):
        assert one(spark, years.release_year(F.array(F.lit("TAG:date=1999-01-01"), F.lit(f"{key}=on 12.1971")), F.lit("/m/1980 - x"), F.lit(1990))) == 1971, key
    ranked = [f"{k}={1900 + i}" for i, k in enumerate(years.ORIGINAL)]
    for i in range(len(ranked)):
        assert one(spark, years.original_year(F.array(*map(F.lit, reversed(ranked[i:]))))) == str(1900 + i)
    cases = [
        (["date=2001"], "/m/1980 - x", 1990, 1980), (["date=2001"], "/m/[1981] x", 1990, 1981), (["date=2001"], "/m/1982_x/", 1990, 1982), (["date=2001"], "/m/1983.", 1990, 1983), (["date=2001"], "/m/1984", 1990, 1984),
        (["date=2001"], "/m/x 1984", 1990, 2001), (["Release Date=2003", "year=2002"], "/m/x", 1990, 2003), (["title=2001", "date=soon"], "/m/x", 1990, 1990), (["nothing"], "/m/19855", None, 0), (None, "/m/x", 999, 0),
        (["originaldate=1971", "originaldate=1972", "originaldate=no"], "/m/x", 0, 1972), (["=1971"], "/m/3000 - x", 0, 0), (["TAG:original_dateish=1955", "a original year=1956"], "/m/x", 0, 1956),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, lines array<string>, path string, known int, want int")
    assert [(r["i"], r["got"]) for r in df.select("i", years.release_year(F.col("lines"), F.col("path"), F.col("known")).alias("got")).orderBy("i").collect()] == [(i, c[3]) for i, c in enumerate(cases)]


def test_targets_of_a_transfer(spark):
    cases = [
        ("AC/DC", 1980, "Back in\nBlack", "A/AC_DC/1980 - Back in Black"), (" the x", 0, "  ", "T/the x/unknown"), ("50 Cent", 999, "y", "5/50 Cent/y"), ("Ünder", 1999, "a/b", "_/Ünder/1999 - a_b"), ("", None, "y", "U/unknown/y"),
    ]
    for artist, year, name, want in cases:
        assert one(spark, paths.library_path(F.lit(artist), F.lit(year), F.lit(name))) == want
    schema = "id long, artist string, album string, year_int int, source_path string"
    wanted = spark.createDataFrame([(1, "A", "X", 1990, "/m/a/x"), (2, "A", "X", 1990, "/gone"), (3, "B", "X", 1990, ""), (4, "C", "Y", 1990, "/gone"), (5, "D", "Z", 0, None), (9, "A", "X", 1990, "/moved")], schema)
    rows = spark.createDataFrame([(1, "A", "X", 1990, "/m/a/x"), (2, "A", "X", 1990, "/gone"), (7, "Q", "x", 1990, "/lib/q/x"), (9, "a", "X", 1990, "/m/nine"), (8, "D", "z", 0, "/lib/d/1977_z"), (4, "C", "Y", 1991, "/m/y")], schema)
    folders = spark.createDataFrame([("/m/a/x",), ("/lib/q/x",), ("/m/nine",), ("/lib/d/1977_z",), ("/m/y",)], "path string")
    tags = spark.createDataFrame([("/m/a/x", ["TAG:TORY=1985"]), ("/m/nine", ["date=1986"])], "path string, lines array<string>")
    found = {r["id"]: tuple(r)[3:] for r in transfer.manifest(wanted, rows, folders, tags, "/lib/").collect()}
    assert found == {
        1: (1985, "/m/a/x", "A/A/1985 - X"),
        2: (1985, "/m/a/x", "A/A/1985 - X"),  # the lowest id of its artist
        3: (1985, "/m/a/x", "B/B/1985 - X"),  # of any artist
        5: (1977, "/lib/d/1977_z", "d/1977_z"),
        9: (1986, "/m/nine", "A/A/1986 - X"),  # its own row
    }


def test_album_keys(spark):
    cases = [
        ({"album_artist": "VA", "artist": "T", "album": "X", "date": "1999-05", "genre": "Rock"}, "/m/a/1980 - b/1.flac", ("VA", "1999", "X", "Rock")),
        ({"artist": "T"}, "/m/a/ 1980 -b/1.flac", ("T", "1980", "b", None)),
        ({"date": "99"}, "/m/_VA/Live 1977 x/1.flac", ("Various Artists", "1977", "Live 1977 x", None)),
        (None, "/m/a/b/1.flac", ("a", "0000", "b", None)),
        (None, "b/1.flac", None),
        ({"album": ""}, "a/1980/1.flac", ("a", "1980", "1980", None)),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, tags map<string,string>, path string")
    found = [r["k"] and tuple(r["k"]) for r in df.select("i", paths.album_key(F.col("tags"), F.col("path")).alias("k")).orderBy("i").collect()]
    assert found == [c[2] for c in cases]


def test_codecs(spark):
    for raw, want in (("mp2", "mp2"), ("WMAPRO", "wmapro"), ("mpegaudio", "mp3"), ("mpeg_layer_3", "mp3"), ("N/A", ""), (" libvorbis ", "vorbis"), ("wmavoice", "wma"), (None, "")):
        assert one(spark, text.codec_name(F.lit(raw))) == want
    cases = [
        ("flac", "x", "", "", "", "/a.mp3", "flac"), ("", "x", "MPEG audio layer 3", "", "", "/a", ""), ("", "0", "MPEG audio layer 3", "", "", "/a", "mp3"), (None, "1", "", "0x0055", "", "/a", "mp3"), ("none", "1", "", "", "", "/a.mp3", "mp3"),
        ("unknown", "1", "Advanced Audio Coding", "", "", "/a", "aac"), ("", "1", "", "", "HE-AAC", "/a", "aac"), ("", "1", "Some  New: Codec", "AB 1", "Main", "/x/a.Foo", "unknown{tag=ab_1;name=some_new_codec;profile=main;ext=foo}"),
        ("", "1", "unknown", "0x0000", "N/A", "/a.foo", ""), ("", "1", "", "[0][0][0][0]", "", "/.foo", "unknown{tag=_0_0_0_0_}"),
    ]
    for stream, index, long, tag, profile, path, want in cases:
        assert one(spark, media.codec_of(*map(F.lit, (stream, index, long, tag, profile, path)))) == want


def test_schedules(spark):
    for minutes, want in ((1, "*/1 * * * *"), (20, "*/20 * * * *"), (60, "0 * * * *"), (90, None), (120, "0 */2 * * *"), (1440, "0 0 * * *"), (0, None), (1500, None)):
        assert one(spark, paths.cron(F.lit(minutes))) == want
    for schedule, now, want in (("*/20 * * * *", 10 * 60 + 19, "10:20"), ("*/20 * * * *", 23 * 60 + 40, "00:00"), ("*/25 * * * *", 605, "10:25"), ("*/25 * * * *", 650, "11:00"), ("0 * * * *", 1439, "00:00"), ("0 */7 * * *", 21 * 60, "00:00"), ("0 */7 * * *", 420, "14:00"), ("0 0 * * *", 5, "00:00"), ("5 4 * * 1", 5, None)):
        assert one(spark, paths.next_run(F.lit(schedule), F.lit(now))) == want
    for minutes, given, want in ((20, None, 1080), (2, None, 120), (1, None, 60), (0, None, 0), (20, 5, 5), (20, 0, 1080)):
        assert one(spark, paths.longest_run(F.lit(minutes), F.lit(given))) == want


def test_names_of_tracks(spark):
    assert parsing.plain_aliases("/a/03:45  01 - Ｃafé ﬁn.FLAC [flac]") == ["03:45 01 - café fin.flac [flac]", "03:45 01 - cafe fin.flac [flac]", "03:45 01 - café fin", "03:45 01 - cafe fin", "café fin.flac", "cafe fin.flac", "café fin", "cafe fin"]
    assert parsing.plain_aliases("Straße.mp3")[0] == "strasse.mp3" and parsing.plain_aliases(None) == parsing.plain_aliases("/") == []
    assert parsing.plain("  Sigur Rós: ÁGÆTIS ") == "sigur ros ag tis"
    known = spark.createDataFrame([(1, 1, "01 - Song.flac", "7"), (2, 1, "02 - Song Two.flac", "9.5"), (3, 1, "song.wav", "8"), (4, 1, "Zed", "x"), (5, 2, "Other", "12")], "known_id long, group long, name string, dr string")
    wanted = spark.createDataFrame([(10, 1, "Song", "standard"), (11, 1, "A Song Two (Live)", "audiophile"), (12, 1, "zed", "standard"), (13, 2, "OTHER.mp3", "odd"), (14, 1, "SONG TWO.ogg", "standard")], "wanted_id long, group long, name string, profile string")
    assert {r["wanted_id"]: (r["dr"], r["grade"]) for r in parsing.graded_names(wanted, known).collect()} == {10: ("8", "B"), 11: ("8", "C"), 12: ("N/A", "N/A"), 13: ("12", "S"), 14: ("9.5", "A")}


def test_segments(spark):
    starts = lambda seconds, mode: [round(x, 6) for x in one(spark, strategy.segment_starts(F.lit(seconds), F.lit(8.0), F.lit(mode)))]
    assert starts(1008.0, "exact") == [80.0, 248.0, 416.0, 584.0, 752.0, 920.0]
    assert starts(1008.0, "fast") == [80.0, 248.0, 416.0, 584.0]
    assert starts(12.0, "fast") == [2.0] and starts(5.0, "exact") == [0.0] and len(starts(33.0, "fast")) == 4
    schema = "track_id long, segment int, cutoff_hz double, source_sr int, target_sr int, hf_present boolean, drop_db double, distance_hz double"
    low = lambda t, n, **how: [tuple(({"track_id": t, "segment": i, "cutoff_hz": 20_000.0, "source_sr": 96_000, "target_sr": 44_100, "hf_present": False, "drop_db": 20.0, "distance_hz": 2000.0} | how).values()) for i in range(n)]
    rows = low(1, 4, source_sr=88_200) + low(2, 4, target_sr=96_000) + low(3, 4, cutoff_hz=None) + low(4, 4, distance_hz=100.0) + low(5, 2, source_sr=88_200) + low(5, 2, source_sr=88_200, target_sr=48_000) + low(6, 4, hf_present=True) + low(7, 4, drop_db=1.0)
    df = spark.createDataFrame(rows, schema)
    assert {r["track_id"]: (r["kind"], r["reason"]) for r in signal.classified(df).where("track_id <> 5").collect()} == {
        1: ("cutoff-limited", "brickwall_cutoff"), 2: ("full-band", "full_band_signal"), 3: ("uncertain", "no_cutoff"), 4: ("uncertain", "boundary_ambiguity"), 6: ("full-band", "hf_presence_guard"), 7: ("uncertain", "gradual_rolloff"),
    }
    assert {r["track_id"]: tuple(r)[1:] for r in strategy.outcome(df).collect()} == {
        1: ("high", "accepted_by_consistency", True), 2: ("high", "accepted_by_consistency", False), 3: ("low", "fallback_due_to_no_signal", False), 4: ("low", "fallback_due_to_boundary_ambiguity", False),
        5: ("low", "fallback_due_to_family_inconsistency", False), 6: ("high", "accepted_by_consistency", False), 7: ("medium", "accepted_by_consistency", False),
    }


def test_guard_bands(spark):
    assert [one(spark, signal.guard_hz(F.lit(r))) for r in (44_100, 176_400, 48_000, 192_000, 50_000)] == [22_050.0, 22_050.0, 24_000.0, 24_000.0, None]


def test_conversions_that_are_refused(spark):
    rows = [(1, 1, "/a/x.wav", "pcm", "96000", 24), (1, 2, "/a/x.m4a", "alac", "96000", 24), (1, 3, "/a/y.mp3", "MP3", "96000", 24), (1, 4, "/a/z.wav", "", "96000", 24), (1, 5, "/a/r.wav", "pcm", "N/A", 24), (1, 6, "/a/b.wav", "pcm", "96000", 0), (1, 7, "/a/l.wav", "pcm", "44100", 16), (1, 8, "/a/d.dsf", "dsd_lsbf", "2822400", 1)]
    df = spark.createDataFrame(rows, "album_id long, position int, path string, codec string, sr string, bits int")
    assert {r["position"]: r["error"] for r in planning.preflight(df, 88_200, 24).collect()} == {
        2: "target collision: '/a/x.wav' and '/a/x.m4a' both map to '/a/x.flac'", 3: "/a/y.mp3: lossy source codec 'mp3' is not allowed for FLAC replace workflow", 4: "/a/z.wav: unable to detect codec",
        5: "/a/r.wav: unable to detect sample rate", 6: "/a/b.wav: unable to detect bit depth", 7: "/a/l.wav: target '88200/24' is higher than source '44100/16' (upscale blocked)",
    }
    assert planning.preflight(df, 88_200, 24, lossy_allowed=True).where("position = 3").count() == 0


def test_releases(spark):
    schema = "query_id long, place int, release_id string, title string, artist string, date string, wanted_title string, wanted_artist string, wanted_year string, source_score string"
    rows = [
        (1, 0, "a", "Ágætis  byrjun", "Sigur Rós", "", "agætis byrjun", "SIGUR ROS", "1999", "100"),  # no year is no fault
        (2, 0, "b", "X", "Y", "1998", "x", "y", "1999", "90"), (2, 1, "c", "X", "Y", "1999-02", "x", "y", "1999", "0"),
        (3, 0, "d", "X", "Young, Neil", "1999", "X", "Neil Young", "", "5"), (4, 0, "e", "X (live)", "Y", "1999", "X", "Y", "1999", "100"), (5, 0, "f", "X", "Y", "1998", "X", "Y", "1999", "100"), (6, 0, " ", "X", "Y", "", "X", "Y", "", "1"),
    ]
    found = {r["query_id"]: (r["release_id"], r["score"]) for r in planning.release_scores(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: ("a", 250), 2: ("c", 250), 3: ("d", 231)}


def test_variants_of_a_data_set(spark):
    sources = spark.createDataFrame([(1, 44_100, 16), (2, 44_100, 24), (3, 48_000, 24), (4, 96_000, 24)], "id long, sr int, bits int")
    found = planning.dataset_matrix(sources, sources.select("id", F.lit("").alias("variant"))).where("variant like '%/%'")
    assert sorted((r["id"], r["variant"]) for r in found.collect()) == [(2, "44100/16"), (3, "44100/16"), (4, "44100/16"), (4, "48000/24")]


def test_bytes_of_sound(spark):
    rows = [(1, 1, "44100", "1", "16", 10.0), (1, 2, "96000", "6", "32", 0.00001), (2, 1, "N/A", "2", "24", 5.0), (3, 1, "48000", "?", "", 1.0)]
    found = {r["album_id"]: (r["bytes"], round(r["seconds"], 6)) for r in pcm_bytes(spark.createDataFrame(rows, "album_id long, position int, sr string, channels string, bits string, seconds double")).collect()}
    assert found == {1: (882_001, 10.00001), 2: (0, 5.0), 3: (288_000, 1.0)}


def test_sizes(spark):
    for n, want in (("0", "0b"), ("1023", "1023b"), ("1024", "1Kb"), ("1536", "1.5Kb"), ("2047", "2Kb"), (str(150 * 1024 + 512), "150Kb"), ("104857600", "100Mb"), ("x", "0b"), (str(5 * 2**40 + 2**39), "5.5Tb"), (str(3000 * 2**40), "3000Tb")):
        assert one(spark, sizes.transfer_size(F.lit(n))) == want
    for n, want in ((0, "0B"), (-5, "0B"), (1023, "1023B"), (1024, "1.00K"), (1280, "1.25K"), (20 * 1024, "20.0K"), (200 * 1024, "200K"), (5 * 2**30, "5.00G"), (5000 * 2**40, "5000T")):
        assert one(spark, sizes.short_size(F.lit(n))) == want
    assert one(spark, sizes.one_line(F.lit("a\tb\r\nc"))) == "a b  c"
    assert [one(spark, sizes.linear_gain(F.lit(x))) for x in (0.0, -6.0, -1.5)] == [1.0, 0.501187, 0.841395]
    assert [one(spark, sizes.fixed_gain(F.lit(x))) for x in (1.0, -1.0, 0.001, -0.002, -0.0019)] == [256, -256, 0, -1, 0]
    assert [one(spark, sizes.short_number(F.lit(x).cast("double"))) for x in (7, 7.5, 7.256, 7.996, None)] == ["7", "7.5", "7.26", "8", "-"]


def test_routes(spark):
    """Every case of what is installed and known, with what must come out."""
    rows, want = [], []
    for sox in (True, False):
        for ffmpeg in (True, False):
            for formats in ([], ["FLAC"], ["flac", "ffmpeg"], ["ffmpeg"], ["opus", "m4a", "vorbis", "aifc", "flac"]):
                for codec, known in (("flac", "flac" in [f.lower() for f in formats]), ("x.aif", "aifc" in formats), ("libvorbis", "vorbis" in formats), ("alac", "m4a" in formats), ("opus", False), ("", False), ("other", False)):
                    low = [f.lower() for f in formats]
                    bridge, writes = sox and ffmpeg and "ffmpeg" in low, sox and "flac" in low
                    reads = sox and known
                    decoder = "sox" if reads else "sox(ffmpeg-in)" if bridge else "ffmpeg" if ffmpeg else "none"
                    encoder = "sox" if writes and reads else "sox(ffmpeg-in)" if writes and bridge else "ffmpeg" if ffmpeg else "none"
                    rows.append((len(rows), codec, "/a/b.other", sox, ffmpeg, formats))
                    want.append((decoder, encoder, "sox" if sox and encoder.startswith("sox") else "ffmpeg", "ffmpeg" if sox and encoder == "sox(ffmpeg-in)" else "autodetect"))
    df = spark.createDataFrame(rows, "i int, codec string, path string, sox boolean, ffmpeg boolean, formats array<string>")
    assert [tuple(r)[1:] for r in routing.routes(df).select("i", "decoder", "encoder", "backend", "input").orderBy("i").collect()] == want
    for raw, codec in (("A.OGA", "ogg"), ("vorbis", "ogg"), ("x.alac", "m4a"), ("y.dca", "dts"), ("z.adts", "aac"), ("MP3", "mp3"), ("a.b", "a.b"), (None, "")):
        assert one(spark, routing.container_codec(F.lit(raw))) == codec
    assert one(spark, routing.codec_of_file(F.lit(""), F.lit("/m/x.Flac"))) == "flac"


def test_logs(spark):
    lines = [("a", 1, "Input True Peak: +1.5 dBTP"), ("a", 2, "Input True Peak: -9"), ("b", 1, "Input True Peak: none"), ("b", 2, "\x1b[31mArt: OK | x\x1b[0m"), ("b", 3, "\x1b[1;33m[x] Art: WARN | y\x1b[0m"), ("c", 1, "Art: ERROR | z"), ("d", 1, "-3")]
    df = spark.createDataFrame(lines, "log string, line_no int, text string")
    assert {r["log"]: r["peak"] for r in logs.true_peaks(df).collect()} == {"a": 1.5, "b": None}
    assert {r["log"]: r["art"] for r in logs.art_lines(df).collect()} == {"b": "Art: WARN | y", "c": "Art: ERROR | z"}
    counts, failed = logs.walk(spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "dir string, code int"), df)
    assert tuple(counts.first()) == (3, 1, 2)
    assert {r["dir"]: r["line"] for r in failed.collect()} == {"a": "a | Art: ERROR | album processing failed", "c": "c | Art: ERROR | z"}


def test_album_reports(spark):
    tracks = spark.createDataFrame([(1, 9.0), (1, 8.0), (1, None), (2, None), (3, 12.0)], "album_id long, dr double")
    albums = spark.createDataFrame([(1, "audiophile", 8.0, "C"), (2, "standard", None, "-"), (3, "standard", 11.6, "S")], "album_id long, profile string, db_dr double, db_class string")
    assert {r["album_id"]: tuple(r)[1:] for r in reports.album_report(tracks, albums).collect()} == {
        1: (3, 2, 8, "C", "B", "album-level scoring preset audiophile changed class B -> C at DR 8", False),
        2: (1, 0, None, "-", "-", "", False),
        3: (1, 1, 12, "S", "S", "", False),
    }
    fields = reports.flattened(spark.createDataFrame([(1, '{"recodeTo": "44100/16", "fakeUpscale": true, "drTotal": 9, "grade": "B", "tracks": {"a": 1}}'), (2, "oops"), (3, '{"recodeTo": "x", "grade": "A"}')], "id int, json string"))
    assert {r["id"]: (r["recodeTo"], r["fakeUpscale"], r["drTotal"], r["genreProfile"], r["ok"]) for r in fields.collect()} == {1: ("44100/16", "1", "9", "standard", True), 2: ("", "0", "", "standard", False), 3: ("x", "0", "", "standard", False)}


def test_order_of_profiles(spark):
    rows = [album(id=i, current_quality=q) for i, q in enumerate(("44100/16", "96000/24", "192000/24", "48000/32f", "mixed", "", "48000/64f", None, "44100/16"))]
    found = catalog.ordered_inventory(spark.createDataFrame(rows, ALBUM), "profile_norm").collect()
    assert [(r["value"], r["n"]) for r in found] == [("__all__", 9), ("48000/64f", 1), ("48000/32f", 1), ("192000/24", 1), ("96000/24", 1), ("44100/16", 2), ("mixed", 1), ("~unknown", 2)]


def test_pages_before_and_after_a_row_join(spark):
    rows = [album(id=i, artist="abc"[i % 3], album=f"x{i % 2}", last_checked_at=100 * (i % 4)) for i in range(30)]
    df = spark.createDataFrame(rows, ALBUM)
    for down, artist in ((True, False), (False, False), (True, True), (False, True)):
        key = lambda r, down=down, artist=artist: (-r[1] if down else r[1], [-ord(c) if artist else ord(c) for c in r[2]], r[3], r[4], r[0])
        view = [r[0] for r in sorted(((i, 100 * (i % 4), "abc"[i % 3], f"x{i % 2}", 1999) for i in range(30)), key=key)]
        i = view[11]
        cursor = (100 * (i % 4), "abc"[i % 3], f"x{i % 2}", 1999, i)
        page = lambda back, down=down, artist=artist, cursor=cursor: [r["id"] for r in catalog.page_after(df, cursor, 7, back, down, artist).collect()]
        assert page(False) == view[12:19] and page(True) == view[4:11]


def test_range_reports(spark):
    lines = [
        "  1. Song One:  DR 12.5", "DR9   -0.10 dB   -12.30 dB   3:45 02. Song Two.flac [flac]", "DR7 x y 1:02:03 /a/b/Three  x", "DR8 x y three  X", "Official DR value: DR11", "DR = 10", "Total DR: 9", "Album DR: D8", "Sampling rate: 44100 Hz", "Average bitrate: 900kbs", "bits per sample: 24 bit", "DRx",
    ]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("none", 1, "nothing")], "report string, line_no int, text string")
    files = spark.createDataFrame([("r", "SONG ONE"), ("r", "02. song two.FLAC"), ("other", "three x")], "report string, file string")
    assert {r["name"]: r["dr"] for r in parsing.report_tracks(df, files).collect()} == {"SONG ONE": 12.5, "02. song two.FLAC": 9.0, "Three x": 7.0, "three X": 8.0}
    assert [tuple(r) for r in parsing.report_totals(df).collect()] == [("r", 8.0, 44100, 900, 24)]
    found = spark.createDataFrame([("d", "d/dr14.txt", 1), ("d", "d/dr14_b.txt", 5), ("d", "d/dr14_a.txt", 5), ("d", "d/x.txt", 9), ("e", "e/DR14.txt", 1)], "dir string, path string, mtime long")
    assert [tuple(r) for r in parsing.newest_reports(found).collect()] == [("d", "d/dr14_a.txt")]


def test_artwork_and_identities(spark):
    schema = "dir string, sidecar string, embedded string, local_width int, local_height int, fetch boolean, least int, remote string, remote_width int, remote_height string"
    rows = [("a", "f.jpg", "1.flac", 300, 400, True, 500, "r", 600, "700"), ("b", "f.jpg", None, 300, 400, True, 500, "r", 600, "300"), ("c", None, "1.flac", 300, 400, False, 500, "r", 900, "900"), ("d", None, None, None, None, True, 500, "r", 1, "?"), ("e", None, None, 0, 0, True, 500, None, 1, "1"), ("f", "f.jpg", None, 0, 400, True, 500, "r", 900, "900")]
    assert {r["dir"]: (r["source"], r["fetched"]) for r in logs.chosen_art(spark.createDataFrame(rows, schema)).collect()} == {"a": ("r", True), "b": ("sidecar:f.jpg", True), "c": ("embedded:1.flac", False), "d": ("r", True), "e": (None, True), "f": ("sidecar:f.jpg", False)}
    for tags, folder, want in (({}, "/m/Young , Neil/1972 - Harvest/", ("Neil Young", "Harvest", "1972")), ({"artist": " X "}, "/m/Y/19 - Z", ("X", "19 - Z", "")), ({"album_artist": "A", "artist": "B", "album": "C"}, "/m/Y/1990-D", ("A", "C", "1990")), (None, "D", ("", "D", ""))):
        df = spark.createDataFrame([(tags, folder)], "t map<string,string>, f string")
        assert tuple(df.select(paths.album_identity(F.col("t"), F.col("f")).alias("i")).first()["i"]) == want


def test_parts_of_a_score(spark):
    schema = "id int, cutoff double, top double, transition boolean, stats boolean, peak double, dr double, span double, ratio double, brickwall boolean"
    rows = [(1, 60.0, 96.0, True, True, -3.0, 15.0, 34.0, 0.5, False), (2, 21.8, 96.0, True, False, None, None, 18.0, 0.18, True), (3, 20.3, 22.05, True, False, None, None, 24.0, 0.0, False)]
    found = {r["id"]: (r["raw_score"], r["score"], r["label"], [(p["factor"], p["points"]) for p in r["parts"]]) for r in planning.score_breakdown(spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        1: (133, 100, "Reference", [("band_class", 10), ("transition_found", 6), ("stats_window", 3), ("peak_amplitude_db", 10), ("dynamic_range_db", 20), ("ultrasonic_extent", 10), ("spectral_dynamic_span", 8), ("high_band_ratio", 4)]),
        2: (22, 22, "Poor", [("band_class", 0), ("transition_found", 6), ("stats_window", -2), ("peak_amplitude_db", -2), ("dynamic_range_db", -5), ("ocr_mastering_stats", -2), ("brickwall_signature", -35)]),
        3: (69, 69, "Fair", [("band_class", 0), ("transition_found", 6), ("stats_window", -2), ("peak_amplitude_db", -2), ("dynamic_range_db", -5), ("ocr_mastering_stats", -2), ("cd_authenticity", 35)]),
    }


def test_fingerprints_of_files(spark, tmp_path):
    """Against a plain reading; only the ends of files are read."""
    import hashlib

    sizes_of = {"a/1.flac": 10, "a/sub/2.flac": 70_000, "a/é.flac": 0, "b/1.flac": 200_000}
    for i, (name, n) in enumerate(sizes_of.items()):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes(range(256)) * (n // 256) + bytes([i]) * (n % 256))

    def plain(album, sample):
        h = hashlib.sha256(b"source-fingerprint-v1\0" + str(sample).encode() + b"\0")
        for path in sorted(str(tmp_path / n) for n in sizes_of if n.startswith(f"{album}/")):
            data, stat = open(path, "rb").read(), os.stat(path)
            h.update(b"\0".join((os.path.relpath(path, tmp_path / album).encode(), str(stat.st_size).encode(), str(stat.st_mtime_ns).encode(), b"")))
            h.update(hashlib.blake2b(data[:sample], digest_size=16).digest() + hashlib.blake2b(data[-sample:] if len(data) > sample else b"", digest_size=16).digest())
        return h.hexdigest()

    rows = [(n.split("/", 1)[0], f"file://{tmp_path}/{n}" if n.startswith("b") else str(tmp_path / n), n.split("/", 1)[1]) for n in sizes_of]
    df = spark.createDataFrame(rows, "album string, path string, name string").repartition(3)
    for sample in (16, 65_536):
        found = {r["album"]: r["fingerprint"] for r in fingerprints.source_fingerprints(df, sample).collect()}
        assert found == {album: plain(album, sample) for album in ("a", "b")}
    before = {r["name"]: r["head"] for r in fingerprints.file_ends(df, 16).collect()}
    big = tmp_path / "b/1.flac"
    data = bytearray(big.read_bytes())
    data[100_000] ^= 1  # neither end
    big.write_bytes(data)
    assert {r["name"]: r["head"] for r in fingerprints.file_ends(df, 16).collect()} == before


def test_replacements_backups_and_known_analyses(spark):
    for p, want in (("44100/16", "44100/16"), ("88200/20", "88200/16"), ("96000/24", "96000/24"), ("96000/32f", "96000/24"), ("48000/64f", "48000/24"), (None, None)):
        assert one(spark, text.replacement_profile(F.lit(p))) == want
    for row, want in ((("Recode to 48/24", "flac", "44100/16", None, 0), "48000/24"), (("", "dts", "48000/24", "96000/32f", 1), "96000/24"), (("", "DCA ", "48000/32", None, 1), "48000/24"), (("Keep as-is", "dts", "48000/24", None, 0), None), (("", "flac", "48000/24", None, 1), None)):
        assert one(spark, text.recode_target(*map(F.lit, row))) == want
    libraries = spark.createDataFrame([("a", True), ("b", False)], "library string, sound boolean")
    backups = spark.createDataFrame([("a", "daily", 1_000_000 - 86_399, True), ("a", "weekly", 1_000_000 - 604_800, True), ("a", "monthly", 999_999, False), ("b", "daily", 1, True)], "library string, period string, mtime long, valid boolean")
    steps = lambda force: {r["period"]: r["step"] for r in mutations.backups_due(libraries, backups, 1_000_000, force).collect()}
    assert steps(False) == {"daily": "keep", "weekly": "replace", "monthly": "replace"} and set(steps(True).values()) == {"replace"}
    assert {r["step"] for r in mutations.backups_due(libraries, backups.limit(0), 5).collect()} == {"make"}
    schema = "path string, ruleset string, mode string, source string, config string"
    cached = spark.createDataFrame([("a", "r", "m", "s", "c", "44100/16", True), ("b", "r", "m", "s", "c", "", True), ("c", "r", "m", "", "c", "x", True), ("d", "r", "m", "s", "c", "x", False), ("e", "q", "m", "s", "c", "x", True)], f"{schema}, target string, done boolean")
    now = spark.createDataFrame([(p, "r", "m", "" if p == "c" else "s", "c", p == "f") for p in "abcdefg"] + [("a2", "r", "m", "s", "c", False)], f"{schema}, details boolean")
    assert {r["path"] for r in mutations.analysed_before(now, cached).where("known").collect()} == {"a"}


def test_names_of_views():
    assert [catalog.view_named(x) for x in ("Default", "GRADES", "queue", "codec", "profile", "upscaled", "enc", "mixed-first", "rarities")] == list(catalog.VIEWS)[:2] + ["replace_queue", "codec_inventory", "encoding_inventory", "upscaled_replace", "encode_only", "scan_failed", "rarity_only"]
    assert [catalog.sort_named(x) for x in ("last", "Dynamic-Range", "profile", "failed", "year_int")] == ["checked", "dr", "curr", "fail", "year"]
    assert [catalog.class_named(x) for x in ("ALL", "SB", "c-f")] == ["all", "s-b", "c-f"]
    for bad in (catalog.view_named, catalog.sort_named, catalog.class_named):
        with pytest.raises(ValueError, match="nonsense"):
            bad("nonsense")


def test_what_changed_since_a_mark(spark, tmp_path):
    """Files newer than the mark by their own metadata, and folders that are newer themselves."""
    for i, name in enumerate(("a/1.flac", "b/2.flac", "b/before-recode/3.flac", "c/4.txt")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
        os.utime(path, (1_600_000_000 + i * 1000,) * 2)
    root, mark = f"file://{tmp_path}", "2020-09-13T12:35:00"  # 1_600_000_500
    found = files.listing(spark, root, mark)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["2.flac", "3.flac", "4.txt"]
    assert files.listing(spark, root).count() == 4
    dirs = spark.createDataFrame([("/m/x", 9), ("/m/y", 1), ("/m/before-recode", 9), ("/m/before-recode/z", 9)], "dir string, mtime long")
    assert sorted(r["dir"] for r in files.changed_folders(spark.createDataFrame([("/m/y/1.flac", 9), ("/m/q/1.txt", 9)], "path string, mtime long"), 5, dirs).collect()) == ["/m/x", "/m/y"]
