"""The queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from cytolake.llm.bpe import op1_bpe_roundtrip
from cytolake.llm.chat import OP10_SQL, op10_chat_format
from cytolake.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from cytolake.llm.html_extract import op4_html_extract
from cytolake.llm.media import op3_media_copies
from cytolake.llm.near_dedup import op2_near_dedup
from cytolake.llm.packing import op7_pack
from cytolake.llm.quality import op6_quality
from cytolake.llm.suffix_dedup import op9_suffix_dedup
from cytolake.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_near_dedup": op2_near_dedup,
    "op3_media_copies": op3_media_copies,
    "op4_html_extract": op4_html_extract,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_pack": op7_pack,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL = {"op5_exact_dedup": OP5_SQL, "op10_chat_format": OP10_SQL}
