"""Which parser a file needs, and which parsed documents are still valid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSERS = ("pdf", "docx")
#: The settings that change what a parser gives.
SETTINGS = ("OCR_ENABLED", "OCR_LANGUAGE", "OCR_DPI", "OCR_MIN_PAGE_CHARS", "OCR_MAX_PAGES", "TESSDATA_PREFIX", "SOFFICE_PATH")


def ending(filename: Column) -> Column:
    """What follows the last point, in lower case; empty without a point."""
    return F.lower(F.when(F.contains(filename, F.lit(".")), F.substring_index(filename, ".", -1)).otherwise(""))


def parser_of(filename: Column) -> Column:
    """The parser of a file by its ending, or null."""
    return F.when(ending(filename).isin(*PARSERS), ending(filename))


def dispatched(files: DataFrame, filename: str = "filename") -> tuple[dict[str, DataFrame], DataFrame]:
    """({parser: its files}, the files that none reads, with the reason)."""
    kind = parser_of(F.col(filename))
    unread = files.where(kind.isNull()).withColumn("reason", F.concat(F.lit("Unsupported file extension: ."), F.coalesce(ending(F.col(filename)), F.lit(""))))
    return {p: files.where(kind == p) for p in PARSERS}, unread


def _short(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def settings_fingerprint(settings: Mapping[str, object]) -> str:
    """16 hexadecimal digits of the settings that parsing depends on; one that isn't set counts as empty."""
    return _short("|".join(f"{k}={settings.get(k, '')!r}" for k in SETTINGS).encode())


def fingerprint(settings: Mapping[str, object], sources: Iterable[tuple[str, bytes]]) -> str:
    """Of the parsers' source files (name, content) and of the settings: a change of either makes parsed documents stale."""
    return f"{_short(b''.join(name.encode() + content for name, content in sorted(sources)))}-{settings_fingerprint(settings)}"


def split_by_validity(parsed: DataFrame, schema_version: str, parser_fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(valid, stale) of parsed documents with the columns schema_version and parser_fingerprint; null in either is stale.

    Both are filters over two narrow columns, so a Parquet scan skips row groups of other versions.
    """
    same = (F.col("schema_version") == schema_version) & (F.col("parser_fingerprint") == parser_fingerprint)
    valid = F.coalesce(same, F.lit(False))
    return parsed.where(same), parsed.where(~valid)
