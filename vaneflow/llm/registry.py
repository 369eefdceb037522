"""The queries of this subpackage and their SQL."""

from . import chat, decontaminate, exact_dedup, hard_negatives, jaccard_join, mixing, quality, secrets, sentencepiece, sharding, suffix_dedup, vector_codes, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_mixing": mixing.op13_mixing,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_sentencepiece": sentencepiece.op3_sentencepiece,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality": quality.op9_quality,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op8_secrets": secrets.OP8_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_mixing": mixing.OP13_SQL,
}
