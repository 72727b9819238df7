"""The registered queries of the corpus operators."""

from __future__ import annotations

from spoor.llm.cohorts import ORACLE_OP11, op11_cohort_retention
from spoor.llm.decontam import ORACLE_OP8, op8_decontaminate
from spoor.llm.html import op4_main_text
from spoor.llm.langid import op9_language_id
from spoor.llm.mixing import op13_source_mixing
from spoor.llm.near import op5_near_join
from spoor.llm.ordering import op10_training_order
from spoor.llm.packing import op1_packing
from spoor.llm.quality import op6_quality
from spoor.llm.ranked import ORACLE_OP12, op12_ranked_search
from spoor.llm.secrets import op3_secrets
from spoor.llm.substring import ORACLE_OP2, op2_substring_dedup
from spoor.llm.transport import op7_transport_stream

QUERIES = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secrets": op3_secrets,
    "op4_main_text": op4_main_text,
    "op5_near_join": op5_near_join,
    "op6_quality": op6_quality,
    "op7_transport_stream": op7_transport_stream,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_training_order": op10_training_order,
    "op11_cohort_retention": op11_cohort_retention,
    "op12_ranked_search": op12_ranked_search,
    "op13_source_mixing": op13_source_mixing,
}
ORACLES = {
    "op2_substring_dedup": ORACLE_OP2,
    "op8_decontaminate": ORACLE_OP8,
    "op11_cohort_retention": ORACLE_OP11,
    "op12_ranked_search": ORACLE_OP12,
}
