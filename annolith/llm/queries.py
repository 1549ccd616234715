"""The queries of this subpackage: opN_<name> on whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import OP7_SQL, op7
from .decontaminate import OP8_SQL, op8
from .language_id import op1
from .license_scan import op2
from .near_dedup import op10
from .packing import op3
from .quality_rules import OP4_SQL, op4
from .repeats import op12
from .secret_scan import op9
from .token_count import op5
from .vector_codes import OP11_SQL, op11
from .warc import OP6_SQL, op6

QUERIES = {
    "op1_language_id": op1,
    "op2_license_scans": op2,
    "op3_best_fit_packing": op3,
    "op4_quality_rules": op4,
    "op5_token_counts": op5,
    "op6_warc": op6,
    "op7_chat_formatting": op7,
    "op8_benchmark_decontamination": op8,
    "op9_secret_scans": op9,
    "op10_minhash_near_dedup": op10,
    "op11_vector_codes": op11,
    "op12_suffix_array_dedup": op12,
}
ORACLE_SQL = {
    "op4_quality_rules": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
}
