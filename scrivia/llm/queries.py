"""The opN_<name> queries and the SQL of those that SQL can express."""

from __future__ import annotations

from scrivia.llm import decontamination, exact_dedup, line_dedup, mixing, neighbours, pii, quality, sharding, simhash, spelling, toxicity, warc, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_sharding": sharding.op6_sharding,
    "op7_simhash": simhash.op7_simhash,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_whitening": whitening.op13_whitening,
}

#: op1 and op3 learn, op2 writes and reads files, op7 hashes with XXH64, op9 searches
#: with look-behind, op12 is approximate and op13 takes eigenvectors: no SQL here, but brute-force versions in the tests.
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
}
