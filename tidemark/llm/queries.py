"""The registered queries of this subpackage and their SQL, by name."""

from . import contexts, conversations, decontam, html, jaccard, licenses, mixing, quality, repetition, sharding, substrings, tokens, toxicity

QUERIES = {
    "op1_html": html.op1_html,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_tokens": tokens.op7_tokens,
    "op8_substrings": substrings.op8_substrings,
    "op9_licenses": licenses.op9_licenses,
    "op10_quality": quality.op10_quality,
    "op11_runs": repetition.op11_runs,
    "op12_contexts": contexts.op12_contexts,
    "op13_repair": conversations.op13_repair,
}
SQL = {"op6_mixing": mixing.OP6_SQL, "op10_quality": quality.OP10_SQL}
