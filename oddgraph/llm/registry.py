"""Queries of the training-data subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from oddgraph.llm.decontaminate import op7_decontaminate
from oddgraph.llm.jaccard import op6_jaccard_join
from oddgraph.llm.langid import op4_language_id
from oddgraph.llm.licenses import op9_license_scan
from oddgraph.llm.middle import op12_fill_in_middle
from oddgraph.llm.oracle import ORACLE
from oddgraph.llm.packing import op8_pack_sequences
from oddgraph.llm.personal import op13_personal_data
from oddgraph.llm.ranked import op11_ranked_search
from oddgraph.llm.repeats import op5_substring_dedup
from oddgraph.llm.sharding import op10_feistel_shards
from oddgraph.llm.toxicity import op2_toxicity
from oddgraph.llm.vectors import op3_embedding_dedup
from oddgraph.llm.wavelet import op1_wavelet_tokens

QUERIES = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontaminate": op7_decontaminate,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_license_scan": op9_license_scan,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_ranked_search": op11_ranked_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_personal_data": op13_personal_data,
}

__all__ = ["ORACLE", "QUERIES"]
