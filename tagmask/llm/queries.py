"""The queries of this folder and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from tagmask.llm.decontaminate import OP11_SQL, op11_benchmark_decontamination
from tagmask.llm.divergence import OP12_SQL, op12_source_divergence
from tagmask.llm.language_id import op4_language_id
from tagmask.llm.media import op3_media_columns
from tagmask.llm.mixing import OP10_SQL, op10_mix_sources
from tagmask.llm.near_dup import op8_near_duplicates
from tagmask.llm.packing import op6_best_fit_packing
from tagmask.llm.repair import op13_conversation_repair
from tagmask.llm.search import op2_topk_search
from tagmask.llm.token_store import op7_token_store
from tagmask.llm.toxicity import op1_toxicity
from tagmask.llm.url_reputation import OP9_SQL, op9_url_reputation
from tagmask.llm.warc import op5_warc_index

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_topk_search": op2_topk_search,
    "op3_media_columns": op3_media_columns,
    "op4_language_id": op4_language_id,
    "op5_warc_index": op5_warc_index,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_store": op7_token_store,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_url_reputation": op9_url_reputation,
    "op10_mix_sources": op10_mix_sources,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {"op9_url_reputation": OP9_SQL, "op10_mix_sources": OP10_SQL, "op11_benchmark_decontamination": OP11_SQL, "op12_source_divergence": OP12_SQL}
