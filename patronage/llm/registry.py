"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from patronage.llm import decontaminate, licenses, mixing, ngram_join, pieces, quality, runs, token_counts, token_files, toxicity, vector_codes, vectors, warc


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_warc": warc.op6_warc,
        "op7_licenses": licenses.op7_licenses,
        "op8_token_files": token_files.op8_token_files,
        "op9_quality": quality.op9_quality,
        "op10_vectors": vectors.op10_vectors,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_source_mix": mixing.op12_source_mix,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op5_decontamination": decontaminate.OP5_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_licenses": licenses.OP7_SQL,
        "op10_vectors": vectors.OP10_SQL,
        "op11_periodic_runs": runs.OP11_SQL,
        "op12_source_mix": mixing.OP12_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
