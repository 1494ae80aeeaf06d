"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from quillspark.llm import html_text, licenses, mixing, quality_classifier, quality_rules, sentencepiece_codec, shingle_join, suffix_dedup, toxicity, vector_dedup

QUERIES = {
    "op1_shingle_join": shingle_join.op1_shingle_join,
    "op2_vector_dedup": vector_dedup.op2_vector_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_html": html_text.op7_html,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_quality": quality_classifier.op9_quality,
    "op10_licenses": licenses.op10_licenses,
}
SQL = {"op4_mixing": mixing.SQL, "op10_licenses": licenses.SQL}
