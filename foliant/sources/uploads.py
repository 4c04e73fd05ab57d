"""Ingest of uploaded files: signatures, sizes, the directories of ZIP files, and one document for each content and owner."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 50 << 20
#: What a DOCX must hold; most members; its expanded size by the largest upload; ratio and size of a bomb.
PARTS, MOST_MEMBERS, EXPANDED, BOMB_RATIO, BOMB_BYTES = ("[Content_Types].xml", "word/document.xml"), 20_000, 4, 20, 20 << 20


def signature(content: Column) -> Column:
    """pdf, docx (any ZIP), or null by a file's first bytes."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(F.startswith(head, F.lit("504B")), "docx")


def zip_fault(content: bytes, most: int = MOST_BYTES) -> str | None:
    """Why a ZIP file isn't taken as a DOCX, by its directory alone: nothing is expanded."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = z.infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return "damaged_zip"
    expanded, packed = sum(m.file_size for m in members), sum(max(1, m.compress_size) for m in members)
    if len(members) > MOST_MEMBERS:
        return "too_many_members"
    if not {m.filename for m in members}.issuperset(PARTS):
        return "missing_parts"
    if expanded > EXPANDED * most:
        return "expands_too_far"
    return "suspicious_ratio" if expanded > BOMB_RATIO * packed and expanded > BOMB_BYTES else None


def accepted(files: DataFrame, owner: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(new documents, rejected files) of binary files (path, length, content, owner).

    A rejected file has its reason. Of equal contents of one owner the first path is the document; contents are compared by
    SHA-256, and only digests and paths are shuffled. Only ZIP files of a fitting size reach Python.
    """

    @F.pandas_udf("string")
    def fault(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else zip_fault(c, most) for c in contents], dtype=object)

    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    named = files.withColumn("kind", signature(F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    judged = named.withColumn("zip_fault", fault(F.when((F.col("kind") == "docx") & (ending == "docx") & (F.col("length") <= most), F.col("content"))))
    reason = F.when(F.col("length") > most, "too_large").when(F.col("length") == 0, "empty").when(F.col("kind").isNull() | (F.col("kind") != ending), "wrong_signature").otherwise(F.col("zip_fault"))
    judged = judged.select("path", "length", owner, "kind", "sha256", reason.alias("reason"))
    fine = judged.where("reason is null").groupBy("sha256", owner).agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.first("kind").alias("kind"), F.first("length").alias("length"))
    return fine, judged.where("reason is not null").select("path", owner, "reason")
