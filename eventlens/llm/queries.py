"""The numbered queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from eventlens.llm import decontaminate, html_text, jaccard, langid, line_dedup, near_dup, packing, quality, secrets, spelling, token_files, vector_codes, warc

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_packing": packing.op2_packing,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_warc": warc.op4_warc,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_language": langid.op10_language,
    "op11_html_text": html_text.op11_html_text,
    "op12_spelling": spelling.op12_spelling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op1_jaccard_join": jaccard.ORACLE_SQL,
    "op3_near_dup": near_dup.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_secret_scan": secrets.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_decontamination": decontaminate.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
