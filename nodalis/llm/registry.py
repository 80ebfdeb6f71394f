"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from nodalis.llm import alignment, byte_bpe, collocations, html_text, mixing, pii, quality, sentencepieces, simhash, syncmers, token_counts, topk, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_mixing": mixing.op4_mixing,
    "op5_html": html_text.op5_html,
    "op6_sentencepiece": sentencepieces.op6_sentencepiece,
    "op7_syncmers": syncmers.op7_syncmers,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
    "op11_collocations": collocations.op11_collocations,
    "op12_alignment": alignment.op12_alignment,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op3_exact_topk": topk.OP3_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
