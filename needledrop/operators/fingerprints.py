"""Fingerprints of an album's files and of an analysis' settings: whether something has to be looked at again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the two kinds of fingerprints begin with: a new one makes all old ones miss.
SOURCE_VERSION, CONFIG_VERSION = "source-fingerprint-v1", "config-fingerprint-v1"
#: Bytes that are read from each end of a file.
SAMPLE_BYTES = 65_536
#: Settings in their order.
SETTINGS = (
    "ruleset", "headroom_hz", "thresh_rel_db", "window_sec", "max_windows", "fp_sample_bytes", "fp_mode", "strategy_config", "segment_codecs", "segment_suffixes", "segment_duration_threshold_sec", "segment_size_threshold_bytes",
    "segment_cue_image_threshold_bytes", "segment_fast_count", "segment_exact_count", "segment_min_seconds", "segment_max_seconds", "segment_consistency_tolerance_hz", "segment_boundary_ambiguity_hz", "segment_strong_majority_ratio",
    "segment_accept_majority_ratio", "segment_early_accept_min", "segment_large_downgrade_ratio", "segment_brickwall_drop_db", "hf_guard_peak_db_threshold", "hf_guard_occupancy_threshold", "hf_guard_energy_ratio_threshold",
)


def _ends(path: str, sample: int) -> tuple[int, int, bytes, bytes]:
    """Size, time of the last change in nanoseconds and digests of the first and last bytes of a file; only these are read."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = files.get_file_info(name)
    with files.open_input_file(name) as f:
        head = f.read_at(min(sample, info.size), 0)
        tail = f.read_at(sample, info.size - sample) if info.size > sample else b""
    return info.size, info.mtime_ns, *(hashlib.blake2b(x, digest_size=16).digest() for x in (head, tail))


def file_ends(files: DataFrame, sample: int = SAMPLE_BYTES) -> DataFrame:
    """album, path, name, size, mtime_ns, head, tail of files (album, path, name: its path below the album), read where the tasks run.

    Paths are of a store that all executors see (with a scheme, or local on one machine). A file that isn't there is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_ends(p, sample) for p in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "size", "mtime_ns", "head", "tail"])

    return files.select("album", "path", "name").mapInArrow(run, f"album {files.schema['album'].dataType.simpleString()}, path string, name string, size long, mtime_ns long, head binary, tail binary")


def source_fingerprints(files: DataFrame, sample: int = SAMPLE_BYTES) -> DataFrame:
    """album, fingerprint of its files (see file_ends) in the order of their paths: names, sizes, times and digests of both ends.

    An album has some dozens of files; what is gathered for one is a hundred bytes for each.
    """
    zero = F.lit(b"\0")
    text = lambda c: F.col(c).cast("string").cast("binary")
    one = F.concat(text("name"), zero, text("size"), zero, text("mtime_ns"), zero, "head", "tail")
    rows = file_ends(files, sample).groupBy("album").agg(F.sort_array(F.collect_list(F.struct("path", F.hex(one).alias("hex")))).alias("all"))
    start = f"{SOURCE_VERSION}\0{sample}\0".encode()
    return rows.select("album", F.sha2(F.concat(F.lit(start), F.unhex(F.array_join(F.transform("all", lambda x: x["hex"]), ""))), 256).alias("fingerprint"))


def config_fingerprint(settings: dict[str, Column]) -> Column:
    """The fingerprint of settings (all of SETTINGS, as text): it changes with any of them."""
    if missing := set(SETTINGS) - set(settings):
        raise ValueError(f"settings are missing: {sorted(missing)}")
    lines = [F.lit(CONFIG_VERSION), *(F.concat(F.lit(f"{name}="), settings[name].cast("string")) for name in SETTINGS)]
    return F.sha2(F.concat_ws("\n", *lines), 256)
