"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op10_bpe
from .fingerprint import ORACLE as FINGERPRINT_SQL
from .fingerprint import op4_fingerprint
from .lines import op1_lines
from .mixing import ORACLE as MIXING_SQL
from .mixing import op5_mixing
from .neardup import ORACLE as NEAR_SQL
from .neardup import op3_minhash
from .quality import op9_quality
from .substring import ORACLE as SUBSTRING_SQL
from .substring import op2_substring
from .toxicity import op7_toxicity
from .warc import ORACLE as WARC_SQL
from .warc import op8_warc
from .webp import op6_webp

QUERIES = {
    "op1_lines": op1_lines,
    "op2_substring": op2_substring,
    "op3_minhash": op3_minhash,
    "op4_fingerprint": op4_fingerprint,
    "op5_mixing": op5_mixing,
    "op6_webp": op6_webp,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
}
ORACLES: dict[str, str] = {
    "op2_substring": SUBSTRING_SQL,
    "op3_minhash": NEAR_SQL,
    "op4_fingerprint": FINGERPRINT_SQL,
    "op5_mixing": MIXING_SQL,
    "op8_warc": WARC_SQL,
}
