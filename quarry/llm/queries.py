"""The registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.llm.decontam import OP8_SQL, op8_winnow_decontam
from quarry.llm.entropy_mix import op2_entropy_mix
from quarry.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from quarry.llm.host_reputation import OP3_SQL, op3_host_reputation
from quarry.llm.language_id import op10_nearest_centroid_lang
from quarry.llm.license_scan import op5_license_scan
from quarry.llm.recurrent_lm import op1_recurrent_lm
from quarry.llm.simhash import op6_simhash_multi_index
from quarry.llm.substring_dedup import op7_suffix_array_dedup
from quarry.llm.token_codes import op4_addressable_tokens

QUERIES = {
    "op1_recurrent_lm": op1_recurrent_lm,
    "op2_entropy_mix": op2_entropy_mix,
    "op3_host_reputation": op3_host_reputation,
    "op4_addressable_tokens": op4_addressable_tokens,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_multi_index": op6_simhash_multi_index,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_winnow_decontam": op8_winnow_decontam,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_nearest_centroid_lang": op10_nearest_centroid_lang,
}

ORACLES = {
    "op3_host_reputation": OP3_SQL,
    "op8_winnow_decontam": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
}
