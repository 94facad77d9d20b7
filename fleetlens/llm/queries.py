"""The queries of this package and, where SQL can express them, their SQL."""

from fleetlens.llm import (op1_topk, op2_jaccard, op3_quality, op4_language, op5_bpe, op6_html, op7_pii, op8_mix, op9_shard,
                           op10_ann, op11_resample, op12_align, op13_chat)

QUERIES = {
    "op1_topk": op1_topk.op1_topk,
    "op2_jaccard": op2_jaccard.op2_jaccard,
    "op3_quality": op3_quality.op3_quality,
    "op4_language": op4_language.op4_language,
    "op5_bpe": op5_bpe.op5_bpe,
    "op6_html": op6_html.op6_html,
    "op7_pii": op7_pii.op7_pii,
    "op8_mix": op8_mix.op8_mix,
    "op9_shard": op9_shard.op9_shard,
    "op10_ann": op10_ann.op10_ann,
    "op11_resample": op11_resample.op11_resample,
    "op12_align": op12_align.op12_align,
    "op13_chat": op13_chat.op13_chat,
}
ORACLE_SQL = {"op1_topk": op1_topk.SQL, "op8_mix": op8_mix.SQL, "op11_resample": op11_resample.SQL}
