"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .chat import ORACLE as CHAT_SQL
from .chat import op1_chat_format
from .decontaminate import ORACLE as DECONTAMINATION_SQL
from .decontaminate import op9_decontamination
from .embeddings import ORACLE as EMBEDDING_SQL
from .embeddings import op6_embedding_dedup
from .htmltext import ORACLE as HTML_SQL
from .htmltext import op10_html_text
from .langid import ORACLE as LANGUAGE_SQL
from .langid import op2_language_id
from .licenses import ORACLE as LICENSE_SQL
from .licenses import op3_license_scan
from .linededup import ORACLE as LINE_DEDUP_SQL
from .linededup import op8_line_dedup
from .packing import op4_packing
from .secrets import op7_secret_scan
from .simhash import op5_simhash

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_html_text": op10_html_text,
}

ORACLES = {"op1_chat_format": CHAT_SQL, "op2_language_id": LANGUAGE_SQL, "op3_license_scan": LICENSE_SQL, "op6_embedding_dedup": EMBEDDING_SQL, "op8_line_dedup": LINE_DEDUP_SQL, "op9_decontamination": DECONTAMINATION_SQL, "op10_html_text": HTML_SQL}
