"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, imatch, langid, licenses, linededup, mixing, ngramjoin, pii, suffixdedup, toxicity

QUERIES = {
    "op1_langid": langid.query,
    "op2_toxicity": toxicity.query,
    "op3_licenses": licenses.query,
    "op4_ngram_jaccard": ngramjoin.query,
    "op5_imatch": imatch.query,
    "op6_decontamination": decontamination.query,
    "op7_pii": pii.query,
    "op8_suffix_dedup": suffixdedup.query,
    "op9_line_dedup": linededup.query,
    "op10_mixing": mixing.query,
}

ORACLES = {"op4_ngram_jaccard": ngramjoin.ORACLE, "op10_mixing": mixing.ORACLE}
