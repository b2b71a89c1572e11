"""The queries of this subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from . import changepoints, decontaminate, lexical, pieces, quality, secrets, simhash, suffixes, tokens, topk, toxicity, url_rules, warc

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_files": tokens.op4_token_files,
    "op5_warc": warc.op5_warc,
    "op6_url_filters": url_rules.op6_url_filters,
    "op7_secrets": secrets.op7_secrets,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_change_points": changepoints.op11_change_points,
    "op12_quality": quality.op12_quality,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLE_SQL = {
    "op1_exact_top_k": topk.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_url_filters": url_rules.OP6_SQL,
    "op7_secrets": secrets.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_suffix_dedup": suffixes.OP9_SQL,
    "op11_change_points": changepoints.OP11_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
