"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_formatting
from .collocations import OP11_SQL, op11_phrase_collocations
from .decontamination import OP10_SQL, op10_benchmark_decontamination
from .lm import op1_lm_scoring
from .packing import op5_best_fit_packing
from .quality import op7_quality_rules
from .quality_classifier import op13_quality_classifier
from .secrets import op9_secret_scans
from .simhash import op4_simhash
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op3_token_counts
from .tokenizer_alignment import op12_tokenizer_alignment
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_suffix_dedup, op3_token_counts, op4_simhash, op5_best_fit_packing, op6_chat_formatting, op7_quality_rules, op8_toxicity, op9_secret_scans, op10_benchmark_decontamination, op11_phrase_collocations, op12_tokenizer_alignment, op13_quality_classifier)}

ORACLES: dict[str, str] = {op6_chat_formatting.__name__: OP6_SQL, op10_benchmark_decontamination.__name__: OP10_SQL, op11_phrase_collocations.__name__: OP11_SQL}
