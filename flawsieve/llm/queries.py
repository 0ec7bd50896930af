"""The queries of this subpackage, and the SQL of those that have some."""

from flawsieve.llm import oracles
from flawsieve.llm.decontamination import op9_benchmark_decontamination
from flawsieve.llm.html_extraction import op8_html_extraction
from flawsieve.llm.language_id import op5_language_id
from flawsieve.llm.line_dedup import op10_line_dedup
from flawsieve.llm.lm_scoring import op7_lm_scoring
from flawsieve.llm.near_dedup import op4_minhash_near_dedup
from flawsieve.llm.packing import op6_packing
from flawsieve.llm.quality_rules import op3_quality_rules
from flawsieve.llm.spelling_variants import op11_spelling_variants
from flawsieve.llm.substring_dedup import op12_substring_dedup
from flawsieve.llm.token_alignment import op13_token_alignment
from flawsieve.llm.token_counts import op1_token_counts
from flawsieve.llm.url_filters import op2_url_filters

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_html_extraction": op8_html_extraction,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {"op2_url_filters": oracles.OP2, "op10_line_dedup": oracles.OP10, "op12_substring_dedup": oracles.OP12}
