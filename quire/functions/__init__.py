"""Column -> Column functions, importable from one place.

They are defined next to the operators that use them and listed here so a
user can write ``from quire.functions import extract_json, head_tail``.
"""

from quire.functions.fmt import num_list, r6, str_list
from quire.operators.archive import clip_abstract, format_authors, idea_json, pick_venue
from quire.operators.attempts import error_tail, run_id, timeout_message
from quire.operators.gate import head_tail, last_tokens, non_paper_flag, reason, strip_ws, tokens
from quire.operators.geometry import (
    affine, align, circle_normalize, ndc, normalize_coord, over_white, point_in_box, quat_to_matrix, slab,
)
from quire.operators.latex import bib_block, cite_keys, figures, insert_bib, sections
from quire.operators.replies import (
    append_turn, clean_control, extract_json, flatten_content, json_candidates, json_field, strip_prompt,
)
from quire.operators.reviews import improvement_prompt, map_to_markdown, score, top_items
from quire.operators.runs import parse_key
from quire.operators.series import compose, mod_add, mod_div, mod_pow, mod_sub
from quire.operators.splits import chars, decode, encode
from quire.operators.vectors import positional_encoding, shift, sinusoidal

__all__ = [
    "affine", "align", "append_turn", "bib_block", "chars", "circle_normalize", "cite_keys", "clean_control",
    "clip_abstract", "compose", "decode", "encode", "error_tail", "extract_json", "figures", "flatten_content",
    "format_authors", "head_tail", "idea_json", "improvement_prompt", "insert_bib", "json_candidates", "json_field",
    "last_tokens", "map_to_markdown", "mod_add", "mod_div", "mod_pow", "mod_sub", "ndc", "non_paper_flag",
    "normalize_coord", "num_list", "over_white", "parse_key", "pick_venue", "point_in_box", "positional_encoding",
    "quat_to_matrix", "r6", "reason", "run_id", "score", "sections", "shift", "sinusoidal", "slab", "str_list",
    "strip_prompt", "strip_ws", "timeout_message", "tokens", "top_items",
]
