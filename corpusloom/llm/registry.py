"""The queries of this subpackage, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .contextmix import op2_context_mixing
from .curriculum import OP9_SQL, op9_source_mix
from .decontam import op3_decontamination
from .fingerprint import op10_fingerprints
from .fixity import OP5_SQL, op5_fixity_audit
from .neardup import op8_near_duplicates
from .ordinal import op7_quality_grades
from .secrets import op6_secret_scans
from .suffixdedup import op4_suffix_dedup
from .tokencount import op1_token_counts

_OPERATORS = (op1_token_counts, op2_context_mixing, op3_decontamination, op4_suffix_dedup, op5_fixity_audit, op6_secret_scans, op7_quality_grades, op8_near_duplicates, op9_source_mix, op10_fingerprints)
QUERIES = {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL: dict[str, str] = {"op5_fixity_audit": OP5_SQL, "op9_source_mix": OP9_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
