"""The queries of this subpackage and, where SQL can express them, their SQL."""

from sigmill.llm import codes, decontaminate, interactions, langid, licenses, lines, lm, mixing, quality, simhash, token_cache, topk, warc

QUERIES = {
    "op3_licenses": licenses.op3_licenses,
    "op4_simhash": simhash.op4_simhash,
    "op1_lm_scores": lm.op1_lm_scores,
    "op2_langid": langid.op2_langid,
    "op5_quality": quality.op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_mixing": mixing.op8_mixing,
    "op9_topk": topk.op9_topk,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_token_counts": token_cache.op11_token_counts,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_interactions": interactions.op13_interactions,
}

ORACLES: dict[str, str] = {
    "op3_licenses": licenses.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_token_counts": token_cache.op11_token_counts,
    "op12_vector_codes": codes.OP12_SQL,
    "op13_interactions": interactions.OP13_SQL,
}
