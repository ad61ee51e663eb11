"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from docgraph.llm.clustering import clustering_sql, op13_clustering
from docgraph.llm.decontaminate import op4_decontaminate
from docgraph.llm.fingerprint import op6_fingerprint
from docgraph.llm.jaccard_join import op7_jaccard
from docgraph.llm.language import op2_language
from docgraph.llm.language_model import op9_lm
from docgraph.llm.mixing import op10_mixing
from docgraph.llm.packing import op11_packing
from docgraph.llm.quality import op1_quality
from docgraph.llm.ranked_search import OP12_SQL, op12_search
from docgraph.llm.sharding import op3_sharding
from docgraph.llm.substring_dedup import op8_dedup
from docgraph.llm.urlfilter import OP5_SQL, op5_urlfilter

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_urlfilter": op5_urlfilter,
    "op6_fingerprint": op6_fingerprint,
    "op7_jaccard": op7_jaccard,
    "op8_dedup": op8_dedup,
    "op9_lm": op9_lm,
    "op10_mixing": op10_mixing,
    "op11_packing": op11_packing,
    "op12_search": op12_search,
    "op13_clustering": op13_clustering,
}

ORACLE_SQL: dict[str, str] = {"op5_urlfilter": OP5_SQL, "op12_search": OP12_SQL, "op13_clustering": clustering_sql()}
