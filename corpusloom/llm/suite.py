"""The ten queries of this package and their SQL."""

from __future__ import annotations

from corpusloom.llm import decontaminate, forest, minhash, passages, quality, sharding, token_counts, unigram, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_near_duplicates": minhash.op3_near_duplicates,
    "op4_nearest": forest.op4_nearest,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_sharding": sharding.op7_sharding,
    "op8_repeated_passages": passages.op8_repeated_passages,
    "op9_sentencepiece": unigram.op9_sentencepiece,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op3_near_duplicates": minhash.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
}
