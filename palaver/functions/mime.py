"""Content types from the first bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sniff_mime(content: Column, valid_utf8: Column) -> Column:
    """PNG, JPEG, GIF, WEBP and PDF by signature; otherwise text or unknown bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png")
            .when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
            .when(head.rlike("^474946383[79]61"), "image/gif")
            .when(head.rlike("^52494646.{8}57454250"), "image/webp")
            .when(F.startswith(head, F.lit("255044462D")), "application/pdf")
            .when(valid_utf8, "text/plain").otherwise("application/octet-stream"))


def is_plain_utf8(content: Column) -> Column:
    """Strict UTF-8 without NUL bytes."""
    text = content.cast("string")
    return F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0"))
