"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, licenses, lm_scoring, manifest, media, mixing, pii, quality, simhash, spelling, substrings, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.op1,
        "op2_licenses": licenses.op2,
        "op3_lm_scoring": lm_scoring.op3,
        "op4_url_filter": url_filter.op4,
        "op5_quality": quality.op5,
        "op6_simhash": simhash.op6,
        "op7_pii": pii.op7,
        "op8_bpe": bpe.op8,
        "op9_media": media.op9,
        "op10_mixing": mixing.op10,
        "op11_substrings": substrings.op11,
        "op12_manifest": manifest.op12,
        "op13_spelling": spelling.op13,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that have any. The others hash with XXH64, learn, compress or tokenize, which SQL can't; tests hold them against brute force."""
    return {"op1_fingerprints": fingerprints.SQL, "op2_licenses": licenses.SQL, "op4_url_filter": url_filter.SQL, "op11_substrings": substrings.SQL, "op12_manifest": manifest.SQL}
