"""The subpackage's queries and the SQL that says the same."""

from __future__ import annotations

from foliant.llm import bpe, exact_dedup, fill_middle, language_id, line_dedup, lm_scoring, minhash, mixing, quality, sharding, spelling, subword, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_language_id": language_id.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_minhash": minhash.op8_minhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_subword": subword.op11_subword,
    "op12_spelling": spelling.op12_spelling,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_sharding": sharding.OP10_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
