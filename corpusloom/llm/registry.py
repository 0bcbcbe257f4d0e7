"""Queries and SQL oracles of the operators, by name."""

from __future__ import annotations

from corpusloom.llm import bpe, decontaminate, exact_dedup, langid, licenses, lines, pii, simhash, substrings, warc

QUERIES: dict = {
    "op1_warc": warc.op1_warc,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_pii": pii.op8_pii,
    "op9_language_id": langid.op9_language_id,
    "op10_bpe": bpe.op10_bpe,
}
ORACLES: dict = {
    "op1_warc": warc.OP1_SQL,
    "op3_substring_dedup": substrings.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_line_dedup": lines.OP7_SQL,
}
