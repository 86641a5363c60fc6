"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from quire.llm import decontamination, embedding_dups, jaccard_join, pieces, quality, sharding, token_counts, token_files, toxicity, url_templates


def queries() -> dict:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op2_quality": quality.op2_quality,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_pieces": pieces.op4_pieces,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_shards": sharding.op6_shards,
        "op7_embedding_dups": embedding_dups.op7_embedding_dups,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_url_templates": url_templates.op9_url_templates,
        "op10_decontamination": decontamination.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_shards": sharding.ORACLE_SQL,
        "op7_embedding_dups": embedding_dups.ORACLE_SQL,
        "op8_jaccard_join": jaccard_join.ORACLE_SQL,
        "op9_url_templates": url_templates.ORACLE_SQL,
        "op10_decontamination": decontamination.ORACLE_SQL,
    }
