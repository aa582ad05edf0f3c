"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import SQL as AUDIT_SQL
from .audit import op13_filter_audit
from .embeddings import op8_embeddings
from .exact import SQL as EXACT_SQL
from .exact import op11_exact_dedup
from .importance import SQL as IMPORTANCE_SQL
from .importance import op12_importance_resampling
from .media import op10_media_columns
from .mixing import op9_mixing
from .packing import op5_packing
from .pii import op4_pii
from .secrets import op7_secrets
from .simhash import op6_simhash
from .substring import SQL as SUBSTRING_SQL
from .substring import op1_substring_dedup
from .toxicity import op2_toxicity
from .warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_embeddings": op8_embeddings,
    "op9_mixing": op9_mixing,
    "op10_media_columns": op10_media_columns,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_SQL,
    "op11_exact_dedup": EXACT_SQL,
    "op12_importance_resampling": IMPORTANCE_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
