"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from cubeframe.llm.counting import op3_token_counts
from cubeframe.llm.decontaminate import OP8_SQL, op8_decontaminate
from cubeframe.llm.fingerprint import op1_fingerprint
from cubeframe.llm.langid import op7_language
from cubeframe.llm.near_copies import op5_near_copies
from cubeframe.llm.packing import op4_pack
from cubeframe.llm.pages import op9_main_text
from cubeframe.llm.passages import op6_passages
from cubeframe.llm.quality import op10_quality
from cubeframe.llm.scoring import op2_pseudo_likelihood

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_pseudo_likelihood": op2_pseudo_likelihood,
    "op3_token_counts": op3_token_counts,
    "op4_pack": op4_pack,
    "op5_near_copies": op5_near_copies,
    "op6_passages": op6_passages,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_main_text": op9_main_text,
    "op10_quality": op10_quality,
}
SQL = {"op8_decontaminate": OP8_SQL}
