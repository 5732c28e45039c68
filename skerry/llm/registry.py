"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from skerry.llm.balanced_shards import op6_balanced_shards
from skerry.llm.byte_cnn import op8_byte_cnn
from skerry.llm.language_id import op2_language_id
from skerry.llm.line_templates import OP4_SQL, op4_line_templates
from skerry.llm.minmax_dedup import OP7_SQL, op7_minmax_dedup
from skerry.llm.one_bit_ann import OP3_SQL, op3_one_bit_ann
from skerry.llm.piece_codec import op10_piece_codec
from skerry.llm.preference_chat import OP1_SQL, op1_preference_chat
from skerry.llm.secret_crf import op5_secret_crf
from skerry.llm.spaced_seeds import OP9_SQL, op9_spaced_seeds


def queries() -> dict:
    ops = (op1_preference_chat, op2_language_id, op3_one_bit_ann, op4_line_templates, op5_secret_crf, op6_balanced_shards, op7_minmax_dedup, op8_byte_cnn, op9_spaced_seeds, op10_piece_codec)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_chat": OP1_SQL, "op3_one_bit_ann": OP3_SQL, "op4_line_templates": OP4_SQL, "op7_minmax_dedup": OP7_SQL, "op9_spaced_seeds": OP9_SQL}
