"""Queries and SQL of this package, for the registry."""

from evidentia.llm.fingerprint import op6_fingerprints
from evidentia.llm.line_dedup import op7_line_dedup
from evidentia.llm.lm_score import op3_lm_scoring
from evidentia.llm.mixing import op10_mixing
from evidentia.llm.near_dedup import op9_near_dedup
from evidentia.llm.neighbours import op1_neighbours
from evidentia.llm.preference import OP8_SQL, op8_preference_formatting
from evidentia.llm.sentencepiece_scan import op2_sentencepiece
from evidentia.llm.token_counts import op5_token_counts
from evidentia.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op8_preference_formatting": op8_preference_formatting,
    "op9_near_dedup": op9_near_dedup,
    "op10_mixing": op10_mixing,
}
SQL = {"op8_preference_formatting": OP8_SQL}
