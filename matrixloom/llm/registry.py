"""The queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from . import bm25, bpe, centroids, exact_dedup, html, licenses, mixing, quality, simhash, toxicity, urls, warc, whitening


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1,
        "op2_toxicity_kneser_ney": toxicity.op2,
        "op3_url_filters": urls.op3,
        "op4_mixing_weights": mixing.op4,
        "op5_bpe_chunk_reuse": bpe.op5,
        "op6_html_crf": html.op6,
        "op7_license_diagonals": licenses.op7,
        "op8_warc_packages": warc.op8,
        "op9_bm25_block_max": bm25.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "op11_compression_quality": quality.op11,
        "op12_embedding_whitening": whitening.op12,
        "op13_elkan_centroids": centroids.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": urls.ORACLE,
        "op4_mixing_weights": mixing.ORACLE,
        "op7_license_diagonals": licenses.ORACLE,
        "op8_warc_packages": warc.ORACLE,
        "op9_bm25_block_max": bm25.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
        "op13_elkan_centroids": centroids.ORACLE,
    }
