"""Queries of the package, by name, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from exselect.llm import exact_dedup
from exselect.llm.alignment import op13_token_alignment
from exselect.llm.bpe import op6_bpe
from exselect.llm.decontaminate import op10_decontaminate
from exselect.llm.exact_dedup import op4_exact_dedup
from exselect.llm.lm import op8_lm_scores
from exselect.llm.near_dedup import op7_near_dedup
from exselect.llm.quality import op9_quality
from exselect.llm.secrets import op3_secrets
from exselect.llm.sharding import op11_shuffled_shards
from exselect.llm.suffix_dedup import op5_suffix_dedup
from exselect.llm.token_counts import op2_token_counts
from exselect.llm.variants import op12_spelling_variants
from exselect.llm.warc import op1_warc

QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_token_counts, op3_secrets, op4_exact_dedup, op5_suffix_dedup, op6_bpe, op7_near_dedup,
              op8_lm_scores, op9_quality, op10_decontaminate, op11_shuffled_shards,
              op12_spelling_variants, op13_token_alignment)
}

ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE}
