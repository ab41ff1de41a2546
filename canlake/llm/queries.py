"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from canlake.llm.embeddings import op10_near_vectors
from canlake.llm.imatch import op4_imatch
from canlake.llm.language import op8_language
from canlake.llm.line_runs import OP12_SQL, op12_line_runs
from canlake.llm.mixing import op5_source_mixing
from canlake.llm.near_duplicates import op2_ngram_join
from canlake.llm.packing import op6_packing
from canlake.llm.phrases import OP13_SQL, op13_phrase_tiles
from canlake.llm.resampling import OP11_SQL, op11_importance_resampling
from canlake.llm.sharding import op3_hilbert_shards
from canlake.llm.token_files import op1_token_files
from canlake.llm.toxicity import op9_toxicity
from canlake.llm.url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_ngram_join": op2_ngram_join,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_imatch": op4_imatch,
    "op5_source_mixing": op5_source_mixing,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_near_vectors": op10_near_vectors,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_line_runs": op12_line_runs,
    "op13_phrase_tiles": op13_phrase_tiles,
}

TWINS = {"op7_url_filter": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_line_runs": OP12_SQL, "op13_phrase_tiles": OP13_SQL}
