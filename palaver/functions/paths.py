"""File paths and file URIs, for POSIX and Windows, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.common import let


def _resolve_dots(parts: Column) -> Column:
    """Drop empty and ``.`` parts, let ``..`` remove its predecessor (never above the root)."""
    named = F.filter(parts, lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    return F.aggregate(named, empty, lambda acc, p: F.when(
        p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(p))))


def normalize_posix(path: Column) -> Column:
    """An absolute POSIX path without dots, repeats or a trailing slash; else NULL."""
    valid = F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\0"))
    clean = F.concat(F.lit("/"), F.array_join(_resolve_dots(F.split(path, "/")), "/"))
    return F.when(valid, clean)


def normalize_windows(path: Column) -> Column:
    r"""``C:\...`` with an upper-case drive, or ``\\host\share\...``; device paths are NULL."""
    def of_flat(flat: Column) -> Column:
        parts = F.struct(F.upper(F.regexp_extract(flat, r"^([A-Za-z]:)\\", 1)).alias("drive"),
                         F.regexp_extract(flat, r"^\\\\((?![?.]\\)[^\\]+\\[^\\]+)", 1).alias("share"))
        return let(parts, lambda p: of_root(flat, p["drive"], p["share"]))

    def of_root(flat: Column, drive: Column, share: Column) -> Column:
        used = F.when(drive != "", F.lit(2)).otherwise(F.length(share) + 2)
        rest = F.substring(flat, used + 1, F.length(flat))

        def joined(tail: Column) -> Column:
            gap = F.when(tail == "", F.lit("")).otherwise(F.lit("\\"))
            return F.when(drive != "", F.concat(drive, F.lit("\\"), tail)).when(
                share != "", F.concat(F.lit("\\\\"), share, gap, tail))
        return let(F.array_join(_resolve_dots(F.split(rest, r"\\")), "\\"), joined)
    return F.when(~F.contains(path, F.lit("\0")), let(F.translate(path, "/", "\\"), of_flat))


def normalize_path(path: Column, platform: Column | str) -> Column:
    """Normal form for ``darwin``/``linux``/``win32``; relative, device and NUL paths give NULL."""
    platform = F.lit(platform) if isinstance(platform, str) else platform
    return F.when(platform == "win32", normalize_windows(path)).otherwise(normalize_posix(path))


def path_key(path: Column, platform: Column | str) -> Column:
    """Comparison form of a path: Windows ignores case."""
    platform = F.lit(platform) if isinstance(platform, str) else platform
    return F.when(platform == "win32", F.lower(path)).otherwise(path)


_FILE_URI = r"^[Ff][Ii][Ll][Ee]:(?://([A-Za-z0-9._-]*))?(/[^?#]*)$"


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps ``+``; malformed escapes or bytes give NULL."""
    decoded = F.try_url_decode(F.regexp_replace(text, r"\+", "%2B"))
    replaced = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(text, F.lit("\ufffd")) \
        & ~text.rlike("(?i)%EF%BF%BD")
    return F.when(~replaced, decoded)


def file_uri_to_path(uri: Column, platform: Column | str) -> Column:
    """Local path of a plain ``file:`` URI; credentials, query, fragment or %2F/%5C give NULL."""
    platform = F.lit(platform) if isinstance(platform, str) else platform
    raw = F.regexp_extract(uri, _FILE_URI, 2)
    usable = uri.rlike(_FILE_URI) & ~raw.rlike("(?i)%(?:2f|5c)")
    parts = F.struct(F.lower(F.regexp_extract(uri, _FILE_URI, 1)).alias("host"), percent_decode(raw).alias("path"))

    def local_path(p: Column) -> Column:
        local = (p["host"] == "") | (p["host"] == "localhost")
        # A bare "C:" keeps its current directory, as a relative drive path.
        drive = F.when(p["path"].rlike(r"^/[A-Za-z]:(?:/|$)"), F.coalesce(
            normalize_windows(F.substring(p["path"], F.lit(2), F.length(p["path"]))),
            F.concat(F.upper(F.substring(p["path"], 2, 2)), F.lit("."))))
        share = normalize_windows(F.concat(F.lit("//"), p["host"], p["path"]))
        windows = F.when(local, drive).otherwise(share)
        return F.when(platform == "win32", windows).when(local, normalize_posix(p["path"]))
    return F.when(usable, let(parts, local_path))


def ancestors(path: Column, separator: str = "/") -> Column:
    """The path itself and every directory above it, as an array."""
    escaped = "\\\\" if separator == "\\" else separator
    parts = F.filter(F.split(path, escaped), lambda p: p != "")
    if separator == "/":
        build = F.transform(F.sequence(F.lit(1), F.size(parts)),
                            lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
        return F.concat(F.array(F.lit("/")), F.when(F.size(parts) > 0, build).otherwise(
            F.array().cast("array<string>")))
    unc = F.startswith(path, F.lit("\\\\"))
    lead = F.when(unc, F.lit("\\\\")).otherwise(F.lit(""))
    first = F.when(unc, 2).otherwise(1)

    def join(n: Column) -> Column:
        body = F.concat(lead, F.array_join(F.slice(parts, F.lit(1), n), "\\"))
        return F.when(~unc & (n == 1), F.concat(body, F.lit("\\"))).otherwise(body)
    return F.transform(F.sequence(first, F.size(parts)), join)


def basename_extension(path: Column) -> Column:
    """Lower-case extension of the last path component, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))
