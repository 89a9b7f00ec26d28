"""The queries of the corpus operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from siftlake.llm.bitsliced import OP1_SQL, op1_top_k
from siftlake.llm.bpe_tree import op11_bpe
from siftlake.llm.bwt import op5_repeat_removal
from siftlake.llm.fingerprint import op9_fingerprints
from siftlake.llm.langid import op7_language_id
from siftlake.llm.lexical import OP12_SQL, op12_lexical_search
from siftlake.llm.mixing import op4_mixing
from siftlake.llm.packing import op10_packing
from siftlake.llm.runs import op13_periodic_runs
from siftlake.llm.sigtree import OP2_SQL, op2_jaccard_join
from siftlake.llm.toxicity import op6_toxicity
from siftlake.llm.wavelet import op8_token_output
from siftlake.llm.wordpiece import op3_token_counts

QUERIES = {
    "op1_top_k": op1_top_k, "op2_jaccard_join": op2_jaccard_join, "op3_token_counts": op3_token_counts, "op4_mixing": op4_mixing, "op5_repeat_removal": op5_repeat_removal, "op6_toxicity": op6_toxicity, "op7_language_id": op7_language_id, "op8_token_output": op8_token_output,
    "op9_fingerprints": op9_fingerprints, "op10_packing": op10_packing, "op11_bpe": op11_bpe, "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op1_top_k": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op12_lexical_search": OP12_SQL}
