"""Column functions of the media model: buckets, hashes, scores, formats. All run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds in seconds (inclusive) and names of the duration buckets.
DURATION_BUCKETS = [(10, "0-10s"), (30, "10-30s"), (60, "30-60s"), (300, "1-5m"), (1800, "5-30m")]
LANDSCAPE_FROM, PORTRAIT_TO = 1.2, 0.8
VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "mov", "webm")


def duration_bucket(seconds: Column) -> Column:
    """Bucket of a duration; null and what isn't positive are `unknown`."""
    out = F.when(seconds.isNull() | (seconds <= 0), "unknown")
    for bound, name in DURATION_BUCKETS:
        out = out.when(seconds <= bound, name)
    return out.otherwise("30m+")


def aspect_class(width: Column, height: Column) -> Column:
    """landscape, portrait or square by width over height; `unknown` where either is null or not positive."""
    ratio = width.cast("double") / F.when(height > 0, height).cast("double")
    bad = width.isNull() | height.isNull() | (width <= 0) | (height <= 0)
    return F.when(bad, "unknown").when(ratio > LANDSCAPE_FROM, "landscape").when(ratio < PORTRAIT_TO, "portrait").otherwise("square")


def hash_text(h: Column) -> Column:
    """A 64-bit hash as lowercase hex without leading zeros."""
    return F.lower(F.hex(h))


def is_hash_text(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-fA-F]{1,16}$"), F.lit(False))


def hash_number(s: Column) -> Column:
    """The hash of a hex text as a signed 64-bit number; null unless the text is 1 to 16 hex digits."""
    return F.when(is_hash_text(s), F.conv(s, 16, -10)).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_score(a: Column, b: Column) -> Column:
    """1 for equal hashes, 0 for opposite ones."""
    return 1 - hamming(a, b) / F.lit(64.0)


def similarity_normalized(x: Column) -> Column:
    """Clamp to [-1, 1] and shift to [0, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) / 2 + 0.5


def score_class(score: Column) -> Column:
    return F.when(score >= 0.95, "high").when(score >= 0.85, "medium").otherwise("low")


def fraction(s: Column) -> Column:
    """`a/b` as a number of two decimals, a zero or missing b counting as 1; 0 for what is no fraction."""
    up, down = F.try_element_at(F.split(s, "/"), F.lit(1)), F.try_element_at(F.split(s, "/"), F.lit(2))
    return F.coalesce(F.round(up.try_cast("double") / F.greatest(F.coalesce(down.try_cast("double"), F.lit(1.0)), F.lit(1.0)), 2), F.lit(0.0))


def clock(seconds: Column) -> Column:
    """h:mm:ss from an hour up, else m:ss."""
    s = F.floor(seconds).cast("long")
    minutes, rest = F.expr("0") + F.floor(s / 60) % 60, s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), minutes.cast("long"), rest)).otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("long"), rest))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def without_token(s: Column) -> Column:
    """Without the last `_token`."""
    return F.regexp_replace(s, "_[^_]*$", "")


def suffix(path: Column) -> Column:
    """Lowercase last suffix of the file name, empty if none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def flag(s: Column) -> Column:
    return F.lower(F.trim(s)).isin("1", "true", "yes", "on")
