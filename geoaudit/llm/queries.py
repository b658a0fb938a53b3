"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from geoaudit.llm import bpe, conversations, decontaminate, jaccard, language, licenses, neardup, negatives, repeats, sharding, toxicity, url_filters, warc

QUERIES = {
    "op1_embedding_neardup": neardup.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_bpe": bpe.op3,
    "op4_ngram_jaccard": jaccard.op4,
    "op5_sharding": sharding.op5,
    "op6_toxicity": toxicity.op6,
    "op7_language_id": language.op7,
    "op8_warc": warc.op8,
    "op9_licenses": licenses.op9,
    "op10_url_filters": url_filters.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_suffix_dedup": repeats.op12,
    "op13_conversation_repair": conversations.op13,
}

#: op6 and op7 learn, op13 needs a checksum that DuckDB lacks, and op1 to op5, op9 and op12 have no SQL that stays cheap on whole tables; tests hold those against brute force.
ORACLE = {
    "op8_warc": warc.SQL,
    "op10_url_filters": url_filters.SQL,
    "op11_hard_negatives": negatives.SQL,
}
