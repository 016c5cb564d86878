"""Names of the queries of this subpackage, their functions and their SQL."""

from __future__ import annotations

from shelfmark.llm.chat_format import OP10_SQL, op10_chat_format
from shelfmark.llm.fill_middle import OP11_SQL, op11_fill_middle
from shelfmark.llm.html_extract import op4_html_extract
from shelfmark.llm.langid import op3_langid
from shelfmark.llm.lm_scoring import op7_lm_scoring
from shelfmark.llm.mixing import op5_mixing
from shelfmark.llm.near_dedup import op9_near_dedup
from shelfmark.llm.periodic_runs import op13_periodic_runs
from shelfmark.llm.spm_sampling import op8_spm_sampling
from shelfmark.llm.suffix_match import OP12_SQL, op12_decontaminate
from shelfmark.llm.tiff import op2_tiff
from shelfmark.llm.topk_search import OP6_SQL, op6_topk_search
from shelfmark.llm.url_filters import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_tiff": op2_tiff,
    "op3_langid": op3_langid,
    "op4_html_extract": op4_html_extract,
    "op5_mixing": op5_mixing,
    "op6_topk_search": op6_topk_search,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_spm_sampling": op8_spm_sampling,
    "op9_near_dedup": op9_near_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_fill_middle": op11_fill_middle,
    "op12_decontaminate": op12_decontaminate,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op6_topk_search": OP6_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_decontaminate": OP12_SQL,
}
