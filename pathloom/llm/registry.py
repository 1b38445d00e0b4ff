"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import balltree, chat, dedup_index, licenses, lines, media, mixing, ngram_join, packing, periodic, pii, quality, secrets

QUERIES = {
    "op1_flac_media": media.query,
    "op2_pii_crf": pii.query,
    "op3_license_scan": licenses.query,
    "op4_secret_scan": secrets.query,
    "op5_chat_format": chat.query,
    "op6_ngram_jaccard": ngram_join.query,
    "op7_packing": packing.query,
    "op8_exact_dedup": dedup_index.query,
    "op9_quality_gam": quality.query,
    "op10_source_mixing": mixing.query,
    "op11_periodic_runs": periodic.query,
    "op12_line_dedup": lines.query,
    "op13_ball_clusters": balltree.query,
}

ORACLES = {
    "op3_license_scan": licenses.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op8_exact_dedup": dedup_index.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op12_line_dedup": lines.ORACLE,
    "op13_ball_clusters": balltree.ORACLE,
}
