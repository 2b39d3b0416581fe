"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from compassframe.llm import (
    class_lm,
    conversation_repair,
    decontamination,
    jaccard_join,
    lexical_search,
    licence_scan,
    linear_quality,
    mixing,
    neighbour_graph,
    sharding,
    suffix_dedup,
    surrogates,
    tree_quality,
)

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_quality_rules": tree_quality.op4_quality_rules,
    "op5_class_lm": class_lm.op5_class_lm,
    "op6_sharding": sharding.op6_sharding,
    "op7_licence_scan": licence_scan.op7_licence_scan,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_classifier": linear_quality.op10_quality_classifier,
    "op11_nearest_neighbours": neighbour_graph.op11_nearest_neighbours,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op3_suffix_dedup": suffix_dedup.OP3_SQL,
    "op8_ngram_jaccard_join": jaccard_join.OP8_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
