"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe, chat, embedding_dedup, exact_dedup, licences, merkle, minhash, online_packing, packing, quality, ranked_search, toxicity, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_licence_scan": licences.op5_licence_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_online_packing": online_packing.op12_online_packing,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op9_warc": warc.OP9_SQL, "op11_ranked_search": ranked_search.OP11_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
