"""Registered queries of the training-data operators and their SQL checks."""

from dossierlens.llm import chat_format, divergence, mixing, prefix_trie, url_filter
from dossierlens.llm.bpe import op5_bpe
from dossierlens.llm.chat_format import op2_chat_format
from dossierlens.llm.decontaminate import op7_decontamination
from dossierlens.llm.divergence import op12_source_divergence
from dossierlens.llm.language import op10_language_id
from dossierlens.llm.mixing import op13_source_mix
from dossierlens.llm.near_duplicates import op8_near_duplicates
from dossierlens.llm.nearest import op6_nearest
from dossierlens.llm.prefix_trie import op11_prefix_trie
from dossierlens.llm.secret_scan import op4_secret_scan
from dossierlens.llm.suffix_dedup import op1_suffix_dedup
from dossierlens.llm.token_counts import op3_token_counts
from dossierlens.llm.url_filter import op9_url_filter

QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_chat_format, op3_token_counts, op4_secret_scan, op5_bpe, op6_nearest, op7_decontamination, op8_near_duplicates, op9_url_filter,
    op10_language_id, op11_prefix_trie, op12_source_divergence, op13_source_mix)}
CHECKS = {"op2_chat_format": chat_format.ORACLE, "op9_url_filter": url_filter.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE,
          "op12_source_divergence": divergence.ORACLE, "op13_source_mix": mixing.ORACLE}
