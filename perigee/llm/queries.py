"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from perigee.llm.bpe_transducer import op8_bpe
from perigee.llm.chat_format import op3_chat_format
from perigee.llm.decontaminate import OP4_SQL, op4_decontaminate
from perigee.llm.html_extract import op9_html_extract
from perigee.llm.language_id import op2_language_id
from perigee.llm.lexical_search import OP13_SQL, op13_lexical_search
from perigee.llm.near_dedup import op10_near_dedup
from perigee.llm.phrase_mining import OP11_SQL, op11_phrase_mining
from perigee.llm.quality_rules import op6_quality_rules
from perigee.llm.substring_dedup import op7_substring_dedup
from perigee.llm.suffix_dedup import op5_suffix_dedup
from perigee.llm.token_counts import op1_token_counts
from perigee.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_html_extract": op9_html_extract,
    "op10_near_dedup": op10_near_dedup,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_toxicity": op12_toxicity,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {
    "op4_decontaminate": OP4_SQL,
    "op11_phrase_mining": OP11_SQL,
    "op13_lexical_search": OP13_SQL,
}
