"""The queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, decontamination, html, licenses, linededup, neardup, pii, quality, tokenfile

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_license_scan": licenses.query,
    "op3_personal_data": pii.query,
    "op4_bpe_codec": bpe.query,
    "op5_token_files": tokenfile.query,
    "op6_line_dedup": linededup.query,
    "op7_quality_classifier": quality.query,
    "op8_nearest_vectors": ann.query,
    "op9_near_duplicates": neardup.query,
    "op10_html_extraction": html.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {"op2_license_scan": licenses.ORACLE_SQL, "op6_line_dedup": linededup.ORACLE_SQL, "op9_near_duplicates": neardup.ORACLE_SQL}
