"""The registered queries of this folder, and SQL for those that DuckDB can express."""

from __future__ import annotations

from .chat_format import OP9_SQL, op9_chat_format
from .fill_middle import OP13_SQL, op13_fill_middle
from .fingerprint import op6_fingerprint
from .language_id import op8_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import OP3_SQL, op3_mixing
from .near_dedup import OP1_SQL, op1_near_dedup
from .period_runs import op11_period_runs
from .piece_codec import op4_piece_codec
from .quality import op2_quality
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .token_count import op7_token_count
from .warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_piece_codec": op4_piece_codec,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_fingerprint": op6_fingerprint,
    "op7_token_count": op7_token_count,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
    "op11_period_runs": op11_period_runs,
    "op12_warc": op12_warc,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_warc": OP12_SQL,
    "op13_fill_middle": OP13_SQL,
}
