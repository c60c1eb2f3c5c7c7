"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from docsearch_spark.llm import (balance, bpe, collocations, decontaminate, infill, langid, lattice, licenses, quotes,
                                 quotient, recompress, sharding, vertical)

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_quote_links": quotes.op2_quote_links,
    "op3_exact_dedup": quotient.op3_exact_dedup,
    "op4_lattice_score": lattice.op4_lattice_score,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_shards": sharding.op7_shards,
    "op8_jaccard_join": vertical.op8_jaccard_join,
    "op9_substring_dedup": recompress.op9_substring_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_entropy_mix": balance.op11_entropy_mix,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": quotient.OP3_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
