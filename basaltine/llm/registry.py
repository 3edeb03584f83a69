"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import decontamination, fingerprints, language_model, near_dedup, pieces, pii, quality, secrets, token_counts, toxicity

QUERIES = {
    "op1_quality": quality.query,
    "op2_decontamination": decontamination.query,
    "op3_near_dedup": near_dedup.query,
    "op4_fingerprints": fingerprints.query,
    "op5_language_model": language_model.query,
    "op6_token_counts": token_counts.query,
    "op7_pieces": pieces.query,
    "op8_toxicity": toxicity.query,
    "op9_pii": pii.query,
    "op10_secrets": secrets.query,
}

ORACLES: dict[str, str] = {"op4_fingerprints": fingerprints.ORACLE}
