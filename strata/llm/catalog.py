"""Queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from strata.llm.code_vectors import OP12_SQL, op12_code_vectors
from strata.llm.decontaminate import OP10_SQL, op10_decontaminate
from strata.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from strata.llm.html_text import op8_html_text
from strata.llm.lm_score import op6_lm_score
from strata.llm.mixing import op7_mixing
from strata.llm.ngram_join import op1_ngram_join
from strata.llm.pii import op5_pii
from strata.llm.quality_rules import op4_quality_rules
from strata.llm.sharding import op13_sharding
from strata.llm.substring_dedup import op2_substring_dedup
from strata.llm.suffix_dedup import op3_suffix_dedup
from strata.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_substring_dedup, op3_suffix_dedup, op4_quality_rules, op5_pii, op6_lm_score, op7_mixing, op8_html_text, op9_toxicity, op10_decontaminate,
                                    op11_hard_negatives, op12_code_vectors, op13_sharding)}

ORACLE: dict[str, str] = {"op10_decontaminate": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_code_vectors": OP12_SQL}
