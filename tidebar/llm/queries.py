"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import divergence, importance, line_dedup
from .byte_bpe import op8_byte_bpe
from .cover_tree import op2_embedding_dedup
from .decontaminate import op7_decontamination
from .divergence import op12_source_divergence
from .html_extract import op9_html_extract
from .importance import op13_importance_resampling
from .language_id import op10_language_id
from .line_dedup import op4_line_dedup
from .minhash import op6_near_dedup
from .quality import op5_quality
from .simple8b import op3_token_ids
from .token_counts import op1_token_counts
from .url_filter import op11_url_filter

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_embedding_dedup, op3_token_ids, op4_line_dedup, op5_quality, op6_near_dedup, op7_decontamination, op8_byte_bpe, op9_html_extract, op10_language_id, op11_url_filter, op12_source_divergence, op13_importance_resampling)}
ORACLE_SQL = {"op4_line_dedup": line_dedup.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_importance_resampling": importance.ORACLE}
