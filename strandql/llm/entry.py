"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from strandql.llm import mixing, perspectives
from strandql.llm.decision_list import op4_decision_list
from strandql.llm.decontaminate import op7_cgk_decontamination
from strandql.llm.huffman import op10_huffman_ids
from strandql.llm.language_id import op2_language_fusion
from strandql.llm.logbilinear import op6_log_bilinear
from strandql.llm.mixing import op8_golden_mix
from strandql.llm.perspectives import op1_perspective_rotation
from strandql.llm.simhash import op3_vp_simhash
from strandql.llm.subword import op5_subword_quality
from strandql.llm.toxicity import op9_nnpu_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_perspective_rotation,
        op2_language_fusion,
        op3_vp_simhash,
        op4_decision_list,
        op5_subword_quality,
        op6_log_bilinear,
        op7_cgk_decontamination,
        op8_golden_mix,
        op9_nnpu_toxicity,
        op10_huffman_ids,
    )
}

SQL: dict[str, str] = {"op1_perspective_rotation": perspectives.OP1_SQL, "op8_golden_mix": mixing.OP8_SQL}
