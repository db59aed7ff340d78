"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from formloom.llm import ann, bpe, chat, exact, fim, html, language, packing, quality, simhash, spelling, sstable, toxicity

QUERIES = {
    "op1_bpe_encode": bpe.op1_bpe_encode,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_nearest_neighbours": ann.op3_nearest_neighbours,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_html_main_text": html.op8_html_main_text,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_token_shards": sstable.op10_token_shards,
    "op11_language_id": language.op11_language_id,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op7_chat_format": chat.OP7_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
