"""Queries of this package and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

import corpus_pipeline
from folioscan.llm import chat, embedding_dedup, exact_dedup, licenses, packing, sentencepiece_ops, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_sentencepiece": sentencepiece_ops.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_licenses": licenses.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_simhash": simhash.query,
    "op7_packing": packing.query,
    "op8_chat": chat.query,
    "op9_toxicity": toxicity.query,
    "op10_warc": warc.query,
}
SQL = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op8_chat": chat.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op10_warc": warc.SQL,
}
