"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, exact_dedup, jaccard_join, lexical, mixing, quality, secrets, suffix_dedup, token_records, toxicity, unigram, vectors, warc


def queries():
    return {
        "op1_warc": warc.op1_warc,
        "op2_quality": quality.op2_quality,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_mixing": mixing.op4_mixing,
        "op5_sentencepiece": unigram.op5_sentencepiece,
        "op6_ngram_jaccard": jaccard_join.op6_ngram_jaccard,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_secrets": secrets.op8_secrets,
        "op9_token_records": token_records.op9_token_records,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_vector_search": vectors.op13_vector_search,
    }


def oracle_sql():
    return {"op1_warc": warc.SQL, "op4_mixing": mixing.SQL, "op6_ngram_jaccard": jaccard_join.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_lexical_search": lexical.SQL, "op13_vector_search": vectors.SQL}
