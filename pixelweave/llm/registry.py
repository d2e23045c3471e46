"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pixelweave.llm.audio import op1_audio_features
from pixelweave.llm.chat import OP8_SQL, REPLY_SQL, op8_chat, reply_trees
from pixelweave.llm.language import op10_language
from pixelweave.llm.packing import op5_packing
from pixelweave.llm.pieces import op3_sentencepiece
from pixelweave.llm.pii import op9_pii
from pixelweave.llm.pitman_yor import op6_pitman_yor
from pixelweave.llm.quality import op4_quality
from pixelweave.llm.simhash import op7_simhash
from pixelweave.llm.sketch import op2_fingerprints

QUERIES = {
    "op1_audio_features": op1_audio_features,
    "op2_fingerprints": op2_fingerprints,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "reply_trees": reply_trees,
}

ORACLE_SQL: dict[str, str] = {"op8_chat": OP8_SQL, "reply_trees": REPLY_SQL}
