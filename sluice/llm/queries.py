"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from .fingerprints import op4_fingerprints
from .language import op6_language
from .lines import op1_line_dedup
from .near import op8_near_duplicates
from .neighbours import op7_near_vectors
from .packing import op9_packing
from .pieces import op3_pieces
from .sharding import op2_consistent_shards
from .suffixes import op10_repeated_passages
from .warc import ORACLE as WARC_ORACLE
from .warc import op5_warc


QUERIES = (op1_line_dedup, op2_consistent_shards, op3_pieces, op4_fingerprints, op5_warc, op6_language, op7_near_vectors, op8_near_duplicates, op9_packing, op10_repeated_passages)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**WARC_ORACLE}
