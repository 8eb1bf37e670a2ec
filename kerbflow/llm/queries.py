"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .audit import OP12_SQL, op12_filter_audit
from .chunks import op3_substring_dedup
from .ctw import op10_ctw_scores
from .decontam import OP5_SQL, op5_decontaminate
from .jaccard import OP8_SQL, op8_ngram_jaccard
from .licenses import op7_license_scan
from .mixing import OP1_SQL, op1_mix_sources
from .pii import op6_pii_surrogates
from .quality import op9_quality_fertility
from .repair import op13_repair_conversations
from .simhash import op11_simhash
from .tokencount import op4_token_counts
from .warc import OP2_SQL, op2_warc

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_warc, op3_substring_dedup, op4_token_counts, op5_decontaminate, op6_pii_surrogates, op7_license_scan, op8_ngram_jaccard, op9_quality_fertility, op10_ctw_scores, op11_simhash, op12_filter_audit, op13_repair_conversations)}
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_warc": OP2_SQL, "op5_decontaminate": OP5_SQL, "op8_ngram_jaccard": OP8_SQL, "op12_filter_audit": OP12_SQL}
