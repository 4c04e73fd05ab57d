"""The queries of this folder's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, langid, licenses, media, mixing, neardup, pieces, pii, quality, urls, warc, whitening
from .common import table


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": _on("documents", pieces.pieces_query),
        "op2_quality_rules": _on("documents", quality.quality_query),
        "op3_url_filters": _on("pages", urls.url_query),
        "op4_minhash_neardup": _on("documents", neardup.neardup_query),
        "op5_warc": _on("pages", warc.warc_query),
        "op6_license_scan": _on("documents", licenses.license_query),
        "op7_mixing": _on("documents", mixing.mixing_query),
        "op8_pii": _on("documents", pii.pii_query),
        "op9_language_id": _on("documents", langid.language_query),
        "op10_media_columns": _on("documents", media.media_query),
        "op11_collocations": _on("documents", collocations.collocation_query),
        "op12_byte_bpe": _on("documents", bpe.bpe_query),
        "op13_whitening": _on("embeddings", whitening.whitening_query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.SQL, "op3_url_filters": urls.SQL, "op4_minhash_neardup": neardup.SQL, "op6_license_scan": licenses.SQL, "op7_mixing": mixing.SQL, "op11_collocations": collocations.SQL}
