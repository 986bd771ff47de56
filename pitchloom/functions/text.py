"""Paths, urls, report strings and duration rules as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted audio file extensions.
AUDIO_EXTENSIONS = (".wav", ".mp3", ".m4a", ".webm", ".ogg")
# Accepted video hosts.
VIDEO_HOSTS = ("youtube.com", "youtu.be")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"([^/.][^/]*)\.[^./]*$", "$1")


def relative_to(path: Column, root: str) -> Column:
    """``path`` below ``root``; any scheme and host in front of it are dropped."""
    return F.regexp_replace(path, r"^.*?" + _quote(root.rstrip("/")) + "/", "")


def _quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def recording_key(path: Column, root: str) -> Column:
    """Relative path without extension: unique where the basename is not."""
    return strip_extension(relative_to(path, root))


def file_key(uri: Column, root: str, ext: str) -> Column:
    """:func:`recording_key` of a file's URI with a known extension.

    Positions instead of patterns, since it runs once per line of text. Escaped
    characters are decoded only where there are any.
    """
    base = re.sub(r"^file:/+", "/", root).rstrip("/") + "/"
    # The decoder is meant for forms and would turn a plus into a space.
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    path = F.when(uri.contains("%"), decoded).otherwise(uri)
    start = F.locate(base, path) + len(base)
    return F.substring(path, start, F.length(path) - start + 1 - len(ext))


def sibling_path(path: Column, root: str, other_root: str, ext: str) -> Column:
    """The file of the same relative path and another extension in a parallel tree."""
    return F.concat(F.lit(other_root.rstrip("/") + "/"), recording_key(path, root), F.lit(ext))


def has_extension(path: Column, allowed: Sequence[str] = AUDIO_EXTENSIONS) -> Column:
    return extension(path).isin(*[e.lower() for e in allowed])


def mentions_host(url: Column, hosts: Sequence[str] = VIDEO_HOSTS) -> Column:
    hit = F.lit(False)
    for h in hosts:
        hit = hit | url.contains(h)
    return hit


def name_matches(name: Column, needle: str) -> Column:
    """Case-insensitive substring search."""
    return F.lower(name).contains(F.lower(F.lit(needle)))


def token_count(scale: Column) -> Column:
    return F.size(F.split(scale, " "))


def percent(p: Column) -> Column:
    """A probability as percent with one decimal, half to even."""
    return F.bround(p * 100, 1)


def excerpt_start(duration: Column, threshold: int = 180, floor_s: int = 60) -> Column:
    """Start of the middle excerpt of a long item, 0 for a short one."""
    third = F.floor(duration / 3).cast("long")
    return F.when(duration > threshold, F.greatest(F.lit(floor_s).cast("long"), third)).otherwise(
        F.lit(0).cast("long")
    )


def excerpt_length(duration: Column, threshold: int = 180, length: int = 90) -> Column:
    return F.when(duration > threshold, F.lit(length).cast("long")).otherwise(duration.cast("long"))


# Fixed value: format of one peak in a report.
PEAK_FORMAT = "bin%3d (%4d¢)=%.4f"


def peak_text(bin_: Column, value: Column) -> Column:
    return F.format_string(PEAK_FORMAT, bin_, bin_ * 10, value)


def peaks_text(peaks: Column) -> Column:
    """Join an array of ``struct(bin, value)`` into one report line."""
    return F.array_join(F.transform(peaks, lambda p: peak_text(p["bin"], p["value"])), ", ")


def bar_text(p: Column, width: int = 50) -> Column:
    return F.repeat(F.lit("█"), F.floor(p * width).cast("int"))
