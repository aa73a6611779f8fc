"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base_queries
from .bpe_automaton import op4_bpe
from .chat_format import OP10_SQL, op10_chat_format
from .fingerprints import op3_fingerprints
from .hidden_markov import op6_hidden_markov
from .html_extraction import op2_html_extraction
from .id_files import op7_id_files
from .near_dedup import op5_near_dedup
from .quality_rules import op1_quality_rules
from .source_mixing import OP9_SQL, op9_source_mixing
from .url_filter import op8_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_fingerprints": op3_fingerprints,
    "op4_bpe": op4_bpe,
    "op5_near_dedup": op5_near_dedup,
    "op6_hidden_markov": op6_hidden_markov,
    "op7_id_files": op7_id_files,
    "op8_url_filter": op8_url_filter,
    "op9_source_mixing": op9_source_mixing,
    "op10_chat_format": op10_chat_format,
    **base_queries.QUERIES,
}
ORACLE_SQL: dict[str, str] = {
    "op9_source_mixing": OP9_SQL,
    "op10_chat_format": OP10_SQL,
    **base_queries.ORACLE_SQL,
}
