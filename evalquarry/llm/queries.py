"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from evalquarry.llm.bagminhash import op6_bagminhash
from evalquarry.llm.bitsliced import OP8_SQL, op8_bitsliced_topk
from evalquarry.llm.decontam import op1_template_decontam
from evalquarry.llm.langid import op4_byte_cnn
from evalquarry.llm.line_dedup import OP5_SQL, op5_line_dedup
from evalquarry.llm.pii import op10_pii
from evalquarry.llm.sharding import op9_external_shuffle
from evalquarry.llm.sp_bpe import op7_sentencepiece
from evalquarry.llm.suffix_dedup import op2_suffix_dedup
from evalquarry.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_template_decontam": op1_template_decontam,
    "op10_pii": op10_pii,
    "op4_byte_cnn": op4_byte_cnn,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op6_bagminhash": op6_bagminhash,
    "op8_bitsliced_topk": op8_bitsliced_topk,
    "op3_warc": op3_warc,
    "op5_line_dedup": op5_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op9_external_shuffle": op9_external_shuffle,
}

ORACLES: dict[str, str] = {
    "op8_bitsliced_topk": OP8_SQL,
    "op3_warc": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
}
