"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embeddings, jaccard, licenses, line_dedup, merkle, mixing, packing, periodic, quality_knn, quality_rules, secrets, toxicity, warc


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_quality_classifier": quality_knn.op3_quality_classifier,
        "op4_embedding_dedup": embeddings.op4_embedding_dedup,
        "op5_packing": packing.op5_packing,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_secret_scans": secrets.op7_secret_scans,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_warc_revisits": warc.op10_warc_revisits,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_license_scans": licenses.op13_license_scans,
    }


def oracle_sql() -> dict[str, str]:
    """Operators 3, 5, 7, 9 and 11 to 13 have no SQL; tests hold them against brute force or held-out labels."""
    return {
        "op1_mixing": mixing.ORACLE_SQL,
        "op2_quality_rules": quality_rules.ORACLE_SQL,
        "op4_embedding_dedup": embeddings.ORACLE_SQL,
        "op6_jaccard_join": jaccard.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op10_warc_revisits": warc.ORACLE_SQL,
    }
