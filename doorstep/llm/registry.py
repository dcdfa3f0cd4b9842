"""Queries of the subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat, decontam, hardneg, jaccard, licenses, lines, lmscore, neardup, pieces, quality, substrings, topk, whitening

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_lm_scoring": lmscore.op5_lm_scoring,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_minhash_neardup": neardup.op10_minhash_neardup,
    "op11_ngram_jaccard": jaccard.op11_ngram_jaccard,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES = {"op1_line_dedup": lines.OP1_SQL, "op2_substring_dedup": substrings.OP2_SQL, "op3_chat_formatting": chat.OP3_SQL, "op7_exact_topk": topk.OP7_SQL,
           "op11_ngram_jaccard": jaccard.OP11_SQL,
    "op12_hard_negatives": hardneg.OP12_SQL}
