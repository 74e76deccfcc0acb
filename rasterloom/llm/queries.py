"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from rasterloom.llm import op10_warc, op11_exact, op12_negatives, op13_trie, op1_substring, op2_bpe, op3_embeddings, op4_quality, op5_topk, op6_simhash, op7_html, op8_mixing, op9_tokens

QUERIES = {
    "op1_substring_dedup": op1_substring.op1_substring_dedup,
    "op2_bpe": op2_bpe.op2_bpe,
    "op4_quality_fm": op4_quality.op4_quality_fm,
    "op3_embedding_dedup": op3_embeddings.op3_embedding_dedup,
    "op5_top_k": op5_topk.op5_top_k,
    "op6_simhash": op6_simhash.op6_simhash,
    "op7_html_text": op7_html.op7_html_text,
    "op8_source_mix": op8_mixing.op8_source_mix,
    "op9_token_files": op9_tokens.op9_token_files,
    "op10_warc_roundtrip": op10_warc.op10_warc_roundtrip,
    "op11_exact_dedup": op11_exact.op11_exact_dedup,
    "op12_hard_negatives": op12_negatives.op12_hard_negatives,
    "op13_prefix_trie": op13_trie.op13_prefix_trie,
}
ORACLES = {"op1_substring_dedup": op1_substring.ORACLE, "op3_embedding_dedup": op3_embeddings.ORACLE, "op5_top_k": op5_topk.ORACLE, "op10_warc_roundtrip": op10_warc.ORACLE, "op8_source_mix": op8_mixing.ORACLE}
ORACLES |= {"op11_exact_dedup": op11_exact.ORACLE, "op12_hard_negatives": op12_negatives.ORACLE, "op13_prefix_trie": op13_trie.ORACLE}
