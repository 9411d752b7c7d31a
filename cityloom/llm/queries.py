"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from cityloom.llm.embeddings import op6_multi_index
from cityloom.llm.jaccard import op7_jaccard_join
from cityloom.llm.mixing import op4_mix_sources
from cityloom.llm.oracles import ORACLE_SQL
from cityloom.llm.packing import op2_pack_best_fit
from cityloom.llm.search import op9_top_k_search
from cityloom.llm.secrets import op10_secret_scan
from cityloom.llm.sharding import op3_ring_shards
from cityloom.llm.substrings import op8_repeated_windows
from cityloom.llm.toxicity import op5_toxicity
from cityloom.llm.warc import op1_warc_packages

QUERIES = {
    "op1_warc_packages": op1_warc_packages,
    "op2_pack_best_fit": op2_pack_best_fit,
    "op3_ring_shards": op3_ring_shards,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_multi_index": op6_multi_index,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_repeated_windows": op8_repeated_windows,
    "op9_top_k_search": op9_top_k_search,
    "op10_secret_scan": op10_secret_scan,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
