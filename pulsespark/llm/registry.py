"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from .bpe import op2_bpe
from .embedding_dedup import OP10_SQL, op10_embedding_dedup
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_extract import op8_html
from .lm import op4_lm
from .minhash import OP5_SQL, op5_minhash
from .packing import op7_packing
from .pii import op3_pii
from .sharding import OP9_SQL, op9_sharding
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_lm": op4_lm,
    "op5_minhash": op5_minhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_html": op8_html,
    "op9_sharding": op9_sharding,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLE_SQL = {
    "op5_minhash": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_sharding": OP9_SQL,
    "op10_embedding_dedup": OP10_SQL,
}
