"""Expressions on paths, file contents, sizes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of image files, and the ticks of 100 ns between 1601 and 1970.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "gif", "webp"]
FILETIME_EPOCH = 116_444_736_000_000_000
#: The first bytes of image formats in hexadecimal, and their types.
MAGIC = [("FFD8FF", "image/jpeg"), ("89504E47", "image/png"), ("47494638", "image/gif"), ("424D", "image/bmp")]


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; empty for none or a name that only begins with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def is_hidden(relative: Column) -> Column:
    """Whether any part of a path below a root begins with a dot."""
    return F.concat(F.lit("/"), relative).rlike(r"[/\\]\.")


def normal_path(path: Column) -> Column:
    """Separators, `.` parts, double and final separators do not count when paths are compared."""
    slashes = F.regexp_replace(path, r"\\", "/")
    parts = F.regexp_replace(F.regexp_replace(slashes, r"(?<=/)(?:\./)+|/\.$|^(?:\./)+", ""), r"/{2,}", "/")
    return F.when(parts == "/", parts).otherwise(F.regexp_replace(parts, "/$", ""))


def filetime(ts: Column) -> Column:
    """A timestamp as ticks of 100 ns since 1601, also before 1970."""
    return F.lit(FILETIME_EPOCH) + F.unix_micros(ts.cast("timestamp")) * 10


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970; 0 where there is no time."""
    return F.coalesce(F.unix_seconds(ts.cast("timestamp")), F.lit(0).cast("long"))


def to_base64(content: Column) -> Column:
    """Without line breaks, whatever the session says."""
    return F.regexp_replace(F.base64(content.cast("binary")), "[\r\n]", "")


def is_jpeg(content: Column) -> Column:
    return (F.octet_length(content) >= 4) & F.startswith(F.hex(content), F.lit("FFD8"))


def mime(content: Column) -> Column:
    """Type by the first bytes; JPEG if none is known."""
    head = F.hex(F.substring(content.cast("binary"), 1, 12))
    out = F.when(F.lit(False), F.lit(""))
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    return out.when(F.substring(head, 9, 16) == "6674797061766966", "image/avif").otherwise("image/jpeg")


def mime_of_base64(text: Column) -> Column:
    """The same for base64 text: the first 16 characters hold the 12 bytes that matter."""
    return mime(F.unbase64(F.substring(text, 1, 16)))


def thumbnail_size(width: Column, height: Column, size: int) -> tuple[Column, Column]:
    """Width and height that fit a square: the longer side is size, the other is cut to a whole number, at least 1.
    The proportion is in single precision; a quotient of such numbers in double precision rounds to the same."""
    w, h = width.cast("float"), height.cast("float")
    wide = w >= h
    short = lambda a, b: F.greatest(F.lit(1), ((a / b).cast("float") * F.lit(size).cast("float")).cast("int"))
    return F.when(wide, F.lit(size)).otherwise(short(w, h)), F.when(wide, short(h, w)).otherwise(F.lit(size))


def format_bytes(n: Column) -> Column:
    """By powers of 1024 with at most one decimal, final zeros dropped."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    units = ["KB", "MB", "GB", "TB"]
    for i, unit in enumerate(units, 1):
        scaled = F.round(n / F.lit(float(1024**i)), 1)
        short = F.regexp_replace(F.format_string("%.1f", scaled), r"\.0$", "")
        value = F.concat(short, F.lit(f" {unit}"))
        out = out.otherwise(value) if i == len(units) else out.when(n < 1024 ** (i + 1), value)
    return out


def megabytes(n: Column) -> Column:
    return F.format_string("%.1f MB", n / F.lit(1_048_576.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rate(count: Column, seconds: Column) -> Column:
    """Items a second; times of nothing count as a nanosecond."""
    return count / F.greatest(seconds, F.lit(1e-9))


def speed_text(rate_: Column) -> Column:
    """Whole numbers from 100 on, else one decimal."""
    return F.when(rate_ >= 100, F.floor(rate_ + 0.5).cast("string")).otherwise(F.format_string("%.1f", rate_))


#: The messages of progress events.
PROGRESS = "Extracting features: %d/%d images (Cache: %d hits, %d misses)"
LOADING = "Loading features: 0/%d images"
LOADED = "Loaded features: %d/%d images from cache (%d to extract)"
EXTRACTED = "Extracted features from %d images (Cache: %d hits, %d misses) at %.0f img/s."


def progress_text(processed: Column, total: Column, hits: Column, misses: Column) -> Column:
    return F.format_string(PROGRESS, processed, total, hits, misses)


def loading_text(total: Column) -> Column:
    return F.format_string(LOADING, total)


def loaded_text(hits: Column, total: Column, misses: Column) -> Column:
    return F.format_string(LOADED, hits, total, misses)


def extracted_text(total: Column, hits: Column, misses: Column, seconds: Column) -> Column:
    """With the images a second as a whole number, 0 if it took no time."""
    return F.format_string(EXTRACTED, total, hits, misses, F.when(seconds > 0, total / seconds).otherwise(F.lit(0.0)))
