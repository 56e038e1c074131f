"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .bpe import op5
from .decontaminate import op10
from .exact_dedup import OP8_SQL, op8
from .language import op7
from .line_dedup import op2
from .minhash import op1
from .quality import op3
from .repeats import op4
from .token_counts import op9
from .warc import OP6_SQL, op6

QUERIES = {
    "op1_near_dedup": op1,
    "op2_line_dedup": op2,
    "op3_quality": op3,
    "op4_repeats": op4,
    "op5_byte_bpe": op5,
    "op6_warc": op6,
    "op7_language": op7,
    "op8_exact_dedup": op8,
    "op9_token_counts": op9,
    "op10_decontaminate": op10,
}

SQL = {
    "op6_warc": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
}
