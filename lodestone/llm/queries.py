"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm.collocations import OP11_SQL, op11_collocations
from lodestone.llm.compaction import OP4_SQL, op4_compaction
from lodestone.llm.decontamination import op1_decontamination
from lodestone.llm.hamming_join import op12_hamming_join
from lodestone.llm.interleaved import interleaved_pages, op3_interleaved
from lodestone.llm.jaccard_join import op6_jaccard_join
from lodestone.llm.lm_scoring import op9_lm_scoring
from lodestone.llm.mixing import OP7_SQL, op7_mixing
from lodestone.llm.periodic_runs import op13_periodic_runs
from lodestone.llm.token_counts import op5_token_counts
from lodestone.llm.token_output import op8_token_output
from lodestone.llm.toxicity import op10_toxicity
from lodestone.llm.url_filter import op2_url_filter

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_interleaved": op3_interleaved,
    "op4_compaction": op4_compaction,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_token_output": op8_token_output,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_hamming_join": op12_hamming_join,
    "op13_periodic_runs": op13_periodic_runs,
    "interleaved_pages": interleaved_pages,
}
ORACLES: dict[str, str] = {
    "op4_compaction": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op11_collocations": OP11_SQL,
}
