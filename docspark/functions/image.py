"""Kinds and limits of images as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest image in bytes.
MOST_BYTES = 50 * 1024 * 1024
#: Parts of content types and their extensions, in the order in which they are tried.
BY_TYPE = (("svg", ".svg"), ("webp", ".webp"), ("png", ".png"), ("gif", ".gif"), ("jpeg", ".jpg"), ("jpg", ".jpg"), ("bmp", ".bmp"), ("ico", ".ico"))
#: First bytes, in hexadecimal, and their extensions.
BY_BYTES = (("89504E470D0A1A0A", ".png"), ("FFD8FF", ".jpg"), ("474946383761", ".gif"), ("474946383961", ".gif"), ("424D", ".bmp"), ("00000100", ".ico"))


def extension(content: Column, content_type: Column) -> Column:
    """By content type, else by the first bytes of at least 12, else null."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, ext in BY_TYPE:
        out = out.when(kind.contains(part), ext)
    head = F.hex(F.substring(content, 1, 12))
    long_enough = F.length(content) >= 12
    for digits, ext in BY_BYTES:
        out = out.when(long_enough & head.startswith(digits), ext)
    out = out.when(long_enough & head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
    text = F.lower(F.substring(content, 1, 100).cast("string"))
    return out.when(long_enough & (text.contains("<svg") | text.startswith("<?xml")), ".svg")


def refusal(scheme: Column, size: Column) -> Column:
    """Why an image is not stored; null if it is."""
    return (
        F.when(~F.coalesce(scheme, F.lit("")).isin("http", "https"), F.lit("unsupported scheme"))
        .when(size > MOST_BYTES, F.lit("image too large"))
        .when(size == 0, F.lit("empty image"))
    )
