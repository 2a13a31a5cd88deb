"""Which program decodes or encodes a file: decision tables over what is installed and what the decoder knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and endings, and the container or codec that they stand for.
CONTAINERS = {
    ".flac": "flac", ".alac": "alac", ".m4a": "m4a", ".mp4": "mp4", ".wav": "wav", ".aif": "aiff", ".aiff": "aiff", ".aifc": "aiff", ".caf": "caf", ".dsf": "dsf", ".dff": "dff", ".wv": "wv",
    ".ape": "ape", ".dts": "dts", ".dca": "dts", ".mp3": "mp3", ".aac": "aac", ".adts": "aac", ".ogg": "ogg", ".oga": "ogg", ".opus": "opus",
}
SAME = {"libvorbis": "ogg", "vorbis": "ogg", "alac": "m4a"}
#: Formats one of which the decoder must know for a codec (itself for others), what it can't find out by itself.
KNOWN_AS = {"aiff": ("aiff", "aif", "aifc"), "ogg": ("ogg", "vorbis")}
NOT_FOUND_OUT = ("opus",)


def _mapped(x: Column, values: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(v) for pair in values.items() for v in pair))[x], x)


def container_codec(name: Column) -> Column:
    """A codec's name or a file's as what it is handled as: by its ending, Ogg for Vorbis, M4A for ALAC; any other in lower case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    end = F.regexp_extract(low, r"(\.[a-z0-9]+)$", 1)
    of_file = F.when(end.isin(*CONTAINERS), _mapped(end, CONTAINERS)).otherwise(low)
    return _mapped(of_file, SAME)


def _knows(formats: Column, codec: Column) -> Column:
    own = F.when(codec != "", F.array_contains(formats, codec)).otherwise(F.lit(False))
    return F.coalesce(reduce(lambda out, k: F.when(codec == k, F.arrays_overlap(formats, F.array(*map(F.lit, KNOWN_AS[k])))).otherwise(out), KNOWN_AS, own), F.lit(False))


class Tools:
    """What is installed: sox, ffmpeg (booleans) and the formats that sox knows (lower-case names). Codecs: see container_codec."""

    def __init__(self, sox: Column, ffmpeg: Column, formats: Column):
        self.sox, self.ffmpeg, self.formats = sox, ffmpeg, formats

    def reads(self, codec: Column) -> Column:
        return self.sox & ~codec.isin("", *NOT_FOUND_OUT) & _knows(self.formats, codec)

    def bridges(self) -> Column:
        return self.sox & self.ffmpeg & F.array_contains(self.formats, "ffmpeg")

    def writes_flac(self) -> Column:
        return self.sox & F.array_contains(self.formats, "flac")


def _first(*table: tuple[Column, str]) -> Column:
    """The name of the first row whose test holds, else none."""
    return F.coalesce(*(F.when(test, name) for test, name in table), F.lit("none"))


def decoder(codec: Column, tools: Tools) -> Column:
    """sox, sox(ffmpeg-in), ffmpeg or none: what reads a codec."""
    return _first((tools.reads(codec), "sox"), (tools.bridges(), "sox(ffmpeg-in)"), (tools.ffmpeg, "ffmpeg"))


def flac_encoder(codec: Column, tools: Tools) -> Column:
    """The same for making FLAC of it: sox only if it writes FLAC as well."""
    return _first((tools.writes_flac() & tools.reads(codec), "sox"), (tools.writes_flac() & tools.bridges(), "sox(ffmpeg-in)"), (tools.ffmpeg, "ffmpeg"))


def codec_of_file(codec: Column, path: Column) -> Column:
    """What a file is handled as: its codec, without one its path's ending."""
    return F.when(F.coalesce(codec, F.lit("")) != "", container_codec(codec)).otherwise(container_codec(F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1))))


def routes(files: DataFrame) -> DataFrame:
    """files with decoder, encoder (of its codec), backend and input of a conversion to FLAC (of its codec, else its ending).

    files: codec, path, sox, ffmpeg, formats (see Tools). Names are worked out before they are looked up, each once.
    """
    r = files.withColumns({"_codec": container_codec(F.col("codec")), "_file": codec_of_file(F.col("codec"), F.col("path")), "_formats": F.transform("formats", F.lower)})
    tools = Tools(F.col("sox"), F.col("ffmpeg"), F.col("_formats"))
    way = F.when(F.col("sox"), flac_encoder(F.col("_file"), tools)).otherwise("ffmpeg")
    r = r.withColumns({"decoder": decoder(F.col("_codec"), tools), "encoder": flac_encoder(F.col("_codec"), tools), "_way": way})
    r = r.withColumns({"backend": F.when(F.col("_way").startswith("sox"), "sox").otherwise("ffmpeg"), "input": F.when(F.col("_way") == "sox(ffmpeg-in)", "ffmpeg").otherwise("autodetect")})
    return r.withColumn("codec", F.col("_codec")).drop("_codec", "_file", "_formats", "_way")


def target_profile(profile: Column) -> Column:
    """A struct of rate, bits and sample format of a canonical profile that can be made; null for depths other than 16, 24 and 32."""
    rate, bits = F.split_part(profile, F.lit("/"), F.lit(1)).try_cast("int"), F.split_part(profile, F.lit("/"), F.lit(2))
    made = F.struct(rate.alias("rate"), bits.cast("int").alias("bits"), F.when(bits == "16", "s16").otherwise("s32").alias("sample_format"))
    return F.when(bits.isin("16", "24", "32") & (rate > 0), made)
