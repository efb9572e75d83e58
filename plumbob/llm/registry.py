"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from plumbob.llm import chat, decontaminate, fingerprints, html_text, ngram_jaccard, pieces, secrets, token_output, toxicity, url_filters

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
    "op3_html": html_text.op3_html,
    "op4_secrets": secrets.op4_secrets,
    "op5_chat": chat.op5_chat,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_token_output": token_output.op10_token_output,
}

ORACLE_SQL = {
    "op2_ngram_jaccard": ngram_jaccard.ORACLE,
    "op5_chat": chat.ORACLE,
    "op6_fingerprints": fingerprints.ORACLE,
    "op8_url_filters": url_filters.ORACLE,
}
