"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .cdx import capture_sql, op10_capture_index
from .chat import chat_sql, op2_chat_parts
from .dedup import op3_near_dedup
from .gif import op1_gif_frames
from .mixing import mixing_sql, op5_mixing
from .packing import op8_packing
from .pii import op6_surrogates
from .quality import op4_quality, quality_sql
from .tokenbin import op7_token_files
from .toxicity import op9_toxicity

QUERIES = {
    "op1_gif_frames": op1_gif_frames,
    "op2_chat_parts": op2_chat_parts,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_surrogates": op6_surrogates,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_capture_index": op10_capture_index,
}
SQL = {
    "op2_chat_parts": chat_sql(),
    "op4_quality": quality_sql(),
    "op5_mixing": mixing_sql(),
    "op10_capture_index": capture_sql(),
}
