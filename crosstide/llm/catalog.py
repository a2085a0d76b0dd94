"""The queries of this package and their check SQL."""

from __future__ import annotations

import corpus_pipeline
from crosstide.llm import bpe, chat, exact, fingerprint, langid, lines, minhash, ordered_packing, packing, secret_scan, spelling, toxicity, trie

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_language_id": langid.op7_language_id,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_chat_format": chat.op10_chat_format,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_ordered_packing": ordered_packing.op13_ordered_packing,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op2_exact_dedup": exact.OP2_SQL,
    "op4_line_dedup": lines.OP4_SQL,
}
