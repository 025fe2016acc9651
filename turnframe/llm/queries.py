"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .decontaminate import op5
from .html_text import op1
from .jaccard_join import op2
from .langid import op6
from .mixing import op7
from .ngram_lm import op10
from .oracles import ORACLES
from .phrase_mining import op11
from .quality_model import op8
from .quality_rules import op4
from .substring_dedup import op9
from .token_files import op3
from .vector_codes import op12
from .warc_zip import op13

QUERIES = {
    "op1_html_main_text": op1,
    "op2_shingle_jaccard_join": op2,
    "op3_token_files": op3,
    "op4_host_quality_rules": op4,
    "op5_wu_manber_decontamination": op5,
    "op6_byte_gru_language": op6,
    "op7_mix_sources": op7,
    "op8_ordinal_quality": op8,
    "op9_sparse_suffix_dedup": op9,
    "op10_elias_fano_lm": op10,
    "op11_phrase_mining": op11,
    "op12_vector_codes": op12,
    "op13_warc_packages": op13,
}

__all__ = ["ORACLES", "QUERIES"]
