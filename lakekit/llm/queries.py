"""The named queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from lakekit.llm import (
    bytebpe,
    decontaminate,
    filteraudit,
    hardnegatives,
    jaccard,
    language,
    licenses,
    packing,
    quality,
    scoring,
    substrings,
    toxicity,
    urlfilter,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_repetition": quality.op2_repetition,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_licenses": licenses.op5_licenses,
    "op6_language_model": scoring.op6_language_model,
    "op7_substrings": substrings.op7_substrings,
    "op8_language": language.op8_language,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_byte_bpe": bytebpe.op11_byte_bpe,
    "op12_hard_negatives": hardnegatives.op12_hard_negatives,
    "op13_filter_audit": filteraudit.op13_filter_audit,
}

ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_repetition": quality.OP2_SQL,
    "op9_url_filter": urlfilter.OP9_SQL,
    "op12_hard_negatives": hardnegatives.OP12_SQL,
    "op13_filter_audit": filteraudit.OP13_SQL,
}
