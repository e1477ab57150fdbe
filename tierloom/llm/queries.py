"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from .chunks import op2_chunks
from .decontaminate import OP9_SQL, op9_decontaminate
from .jpeg import op1_jpeg
from .license import op5_license
from .lines import OP4_SQL, op4_lines
from .mix import op3_mix
from .quality import op10_quality
from .shard import op8_shard
from .simhash import op7_simhash
from .toxicity import op6_toxicity

QUERIES = {
    "op1_jpeg": op1_jpeg,
    "op2_chunks": op2_chunks,
    "op3_mix": op3_mix,
    "op4_lines": op4_lines,
    "op5_license": op5_license,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_shard": op8_shard,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
}
SQL = {
    "op4_lines": OP4_SQL,
    "op9_decontaminate": OP9_SQL,
}
