"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .bpe import op9_bpe
from .jaccard import op7_ngram_jaccard
from .licenses import op2_license_scan
from .lines import OP8_SQL, op8_line_dedup
from .mixture import op1_context_mixing
from .mixing import OP3_SQL, op3_mixing
from .packing import op12_packing
from .quality import op10_quality_rules
from .substrings import op5_substring_dedup
from .vectors import op6_near_vectors
from .warc import op4_warc
from .whitening import op11_whitening

QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_vectors": op6_near_vectors,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}

SQL = {
    "op3_mixing": OP3_SQL,
    "op8_line_dedup": OP8_SQL,
    "op13_filter_audit": OP13_SQL,
}
