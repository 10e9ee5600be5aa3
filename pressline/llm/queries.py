"""Registry of the training-data queries and of their DuckDB SQL."""

from __future__ import annotations

from .quality_rules import ABLATIONS_SQL, OP3_SQL, op3_quality_rules, quality_ablations
from .simhash import op7_simhash_near_dedup
from .secret_scan import op2_secret_scan
from .mixing import op8_mixing
from .decontaminate import op4_decontamination
from .lm_score import op6_lm_scoring
from .html_extract import op5_html_extraction
from .language_id import op9_language_id
from .token_counts import op10_token_counts
from .suffix_dedup import op1_suffix_array_dedup
from .divergence import OP11_SQL, op11_source_divergence
from .license_scan import OP12_SQL, op12_license_scan
from .resample import OP13_SQL, op13_resampling

QUERIES = {
    "op3_quality_rules": op3_quality_rules,
    "quality_ablations": quality_ablations,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op8_mixing": op8_mixing,
    "op4_decontamination": op4_decontamination,
    "op6_lm_scoring": op6_lm_scoring,
    "op5_html_extraction": op5_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_license_scan": op12_license_scan,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL = {
    "op3_quality_rules": OP3_SQL,
    "quality_ablations": ABLATIONS_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_resampling": OP13_SQL,
}
