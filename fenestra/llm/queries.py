"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from fenestra.llm import backoff, bpe, lines, matroska, mixing, phrases, pii, quality, ranked, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_matroska": matroska.op2_matroska,
    "op3_line_frequency": lines.op3_line_frequency,
    "op4_stupid_backoff": backoff.op4_stupid_backoff,
    "op5_simhash": simhash.op5_simhash,
    "op6_fixity": warc.op6_fixity,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_pii": pii.op10_pii,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_quality": quality.op12_quality,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {
    "op3_line_frequency": lines.OP3_SQL,
    "op4_stupid_backoff": backoff.OP4_SQL,
    "op6_fixity": warc.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_ranked_search": ranked.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
