"""What a probe tells about a file, as columns: depths, codecs, rates, labels and time limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from needledrop.functions import text

#: File names with these endings are audio.
AUDIO = ("flac", "alac", "m4a", "wav", "aiff", "aif", "aifc", "caf", "dsf", "dff", "wv", "ape", "dts", "dca", "mp4", "mp3", "aac", "ogg", "opus")
#: Sample formats and their bits; floats have a label of their own.
SAMPLE_BITS = {"s16": 16, "s16p": 16, "s24": 24, "s24p": 24, "s32": 32, "s32p": 32, "flt": 32, "fltp": 32, "dbl": 64, "dblp": 64}
FLOATS = {"flt": "32f", "fltp": "32f", "dbl": "64f", "dblp": "64f"}
#: Codecs and file endings whose decoding is dear, and from which size or length on a track is.
DEAR_CODECS = ("ape", "dst", "wavpack", "wv", "dsf", "dff", "dsd_lsbf", "dsd_msbf", "dsd_lsbf_planar", "dsd_msbf_planar")
DEAR_ENDINGS = ("ape", "wv", "dsf", "dff")
LONG_SECONDS, LARGE_BYTES, SHEET_BYTES = 900.0, 250 << 20, 100 << 20


def mapped(x: Column, values: dict) -> Column:
    """values[x], null where there is none."""
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))[x]


def ending(path: Column) -> Column:
    """The lower-case ending of a path's name, empty without a point."""
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)


def is_audio(path: Column) -> Column:
    return ending(path).isin(*AUDIO)


def sample_bits(fmt: Column) -> Column:
    return F.coalesce(mapped(text.norm(fmt), SAMPLE_BITS), F.lit(0))


def sample_label(fmt: Column) -> Column:
    x = text.norm(fmt)
    return F.coalesce(mapped(x, FLOATS), mapped(x, SAMPLE_BITS).cast("string"), F.lit(""))


def whole(x: Column) -> Column:
    """A number of digits only that is above zero, else null."""
    digits = text.trimmed(x)
    return F.when(digits.rlike("^[0-9]+$") & (digits.try_cast("long") > 0), digits.try_cast("long"))


def depth_label(raw: Column, container: Column, fmt: Column, codec: Column) -> Column:
    """Bits of a file: raw sample, else container, else the sample format; DSD has 24 at least. Empty if unknown."""
    label = F.coalesce(whole(raw).cast("string"), whole(container).cast("string"), sample_label(fmt))
    dsd = codec.startswith("dsd") | (codec == "dst")
    return F.when(dsd & (F.coalesce(whole(label), F.lit(0)) < 24), "24").otherwise(label)


def codec_of(stream: Column, index: Column, long_name: Column, tag: Column, profile: Column, path: Column) -> Column:
    """The codec of a file's stream: its name; else what its long name, tag or profile or the file's ending tell, else what
    is known of it as unknown{tag=...;name=...;profile=...;ext=...}; empty if it is no stream (index: not a number) or nothing is known.
    """
    name, long, low = text.codec_name(stream), text.plain_word(long_name), text.plain_word(profile)
    mark, hidden = text.plain_word(tag), F.element_at(F.split(path, "/"), -1).startswith(".")
    end = F.when(hidden, "").otherwise(text.plain_word(ending(path)))
    guess = (
        F.when(long.contains("mpeg_audio_layer_3") | (mark == "0x0055") | (end == "mp3"), "mp3")
        .when(long.contains("vorbis"), "vorbis")
        .when(long.contains("opus") | (end == "opus"), "opus")
        .when(long.contains("advanced_audio_coding") | long.contains("aac") | low.contains("aac"), "aac")
        .when(long.contains("windows_media_audio") | (end == "wma"), "wma")
    )
    told = lambda x, label, *nothing: F.when(~x.isin("", *nothing), F.concat(F.lit(f"{label}="), x))
    details = F.array_compact(F.array(told(mark, "tag", "0x0000"), told(long, "name", "unknown", "n_a"), told(low, "profile", "unknown", "n_a")))
    rest = F.when(F.size(details) > 0, F.concat(F.lit("unknown{"), F.concat_ws(";", details, told(end, "ext")), F.lit("}"))).otherwise("")
    is_stream = F.coalesce(text.trimmed(index.cast("string")).rlike("^[0-9]+$"), F.lit(False))
    return F.when(name != "", name).when(is_stream, F.coalesce(guess, rest)).otherwise("")


def bitrate(stream: Column, container: Column) -> Column:
    """Bits a second of the stream, else of the container, else 0."""
    return F.coalesce(whole(stream), whole(container), F.lit(0))


def kilobits(bps: Column) -> Column:
    return F.floor((bps + 500) / 1000).cast("long")


def bitrate_label(bps: Column) -> Column:
    return F.when(bps > 0, F.concat(F.bround(bps / 1000.0).cast("long").cast("string"), F.lit("k"))).otherwise("")


def family_label(rate: Column) -> Column:
    return F.when(rate % 48000 == 0, "48k-family").when(rate % 44100 == 0, "44.1k-family").otherwise("fallback")


def dsd_ceiling(rate: Column) -> Column:
    """rate, family, policy of the PCM that a DSD source becomes: its family's highest, or its own rate if that is lower."""
    own = F.when(rate % 44100 == 0, "44.1k-family").when(rate % 48000 == 0, "48k-family")
    family = F.when(rate > 0, own)
    top = F.when(family == "48k-family", 192000).otherwise(176400)
    lower = (rate > 0) & (rate < top)
    return F.struct(F.when(lower, rate).otherwise(top).cast("int").alias("rate"), F.coalesce(family, F.lit("fallback")).alias("family"), F.when(lower, "no-upscale").otherwise("max-ceiling").alias("policy"))


def strategy(codec: Column, path: Column, has_sheet: Column, size: Column, seconds: Column) -> Column:
    """strategy (segment, fast) and reasons: whether a track is dear enough to be judged by segments."""
    name, end = text.norm(codec), ending(path)
    dear = name.isin(*DEAR_CODECS) | end.isin(*DEAR_ENDINGS)
    reasons = F.array_compact(
        F.array(
            F.when(dear, F.concat(F.lit("expensive_codec:"), F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("."), end)))),
            F.when(has_sheet & (size >= SHEET_BYTES), "cue_backed_large_image"),
            F.when(seconds >= LONG_SECONDS, F.concat(F.lit("long_duration:"), F.floor(seconds).cast("string"), F.lit("s"))),
            F.when(size >= LARGE_BYTES, F.concat(F.lit("large_file:"), size.cast("string"))),
        )
    )
    some = F.size(reasons) > 0
    return F.struct(F.when(some, "segment").otherwise("fast").alias("strategy"), F.when(some, F.array_join(reasons, ",")).otherwise("normal_source").alias("reasons"))


def mode(raw: Column) -> Column:
    """fast, exact or auto of what was asked for; anything else is auto."""
    x = text.norm(raw)
    return F.when(x.isin("fast", "exact"), x).otherwise("auto")


def decode_seconds(window: Column, seconds: Column) -> Column:
    """How long a decode may take."""
    least = F.greatest(F.lit(20.0), window * 4.0)
    return F.when(seconds > 0, F.greatest(least, F.least(seconds * 2.0, F.lit(300.0)))).otherwise(least)


def analysis_rate(rate: Column) -> Column:
    return F.least(F.bround(rate).cast("int"), F.lit(192000))


def truly_lossless(codec: Column, bps: Column) -> Column:
    """FLAC or ALAC, with over 500 kbit/s or an unknown rate."""
    return text.norm(codec).isin("flac", "alac") & ((bps > 500_000) | (bps == 0))


def title_case(x: Column) -> Column:
    return F.initcap(text.trimmed(x))


def axis_khz(label: Column) -> Column:
    """All frequencies from 8 to 384 kHz that a label names, with or without a unit (from 1000 on plain numbers are Hz)."""
    pattern = r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:khz|k|hz)?"
    found = F.transform(F.regexp_extract_all(label, F.lit(pattern), F.lit(0)), F.lower)

    def khz(x: Column) -> Column:
        n = F.regexp_extract(x, r"^([0-9]+(?:\.[0-9]+)?)", 1).cast("double")
        return F.when(x.rlike("k(hz)?$"), n).when(x.endswith("hz") | (n >= 1000), n / 1000)

    return F.filter(F.transform(found, khz), lambda x: x.between(8.0, 384.0))


#: The tops of axes that profiles are told by, in kHz.
TIERS = (22.05, 24.0, 48.0, 96.0)


def nearest_tier(khz: Column) -> Column:
    """The tier that is nearest, the lower of two."""
    return F.array_min(F.array(*(F.struct(F.abs(khz - t).alias("away"), F.lit(t).alias("tier")) for t in TIERS)))["tier"]


def row_khz(row: Column, rows: Column, most: Column) -> Column:
    """The frequency of a row of an image whose first row is `most` kHz and whose last is 0."""
    return F.when((rows <= 1) | (most <= 0), 0.0).otherwise(most * (1 - row / (rows - 1)))


def khz_row(khz: Column, rows: Column, most: Column) -> Column:
    bounded = F.greatest(F.lit(0.0), F.least(khz, most))
    return F.when((rows <= 1) | (most <= 0), 0).otherwise(((1 - bounded / most) * (rows - 1)).cast("int"))
