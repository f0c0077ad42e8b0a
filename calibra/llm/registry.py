"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from .decontam import OP6_SQL, op6_decontam
from .html import op5_html
from .licenses import OP10_SQL, op10_licenses
from .linededup import OP4_SQL, op4_linededup
from .ngramjoin import OP9_SQL, op9_ngramjoin
from .packing import op3_packing
from .quality import op7_quality
from .rules import OP2_SQL, op2_base_counts, op2_rules
from .toxicity import op1_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_rules": op2_rules,
    "op2_base_counts": op2_base_counts,
    "op3_packing": op3_packing,
    "op4_linededup": op4_linededup,
    "op5_html": op5_html,
    "op6_decontam": op6_decontam,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_ngramjoin": op9_ngramjoin,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op2_base_counts": OP2_SQL,
    "op4_linededup": OP4_SQL,
    "op6_decontam": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op9_ngramjoin": OP9_SQL,
    "op10_licenses": OP10_SQL,
}
