"""Registered queries of the operators in this folder, and the SQL twins of those SQL can express."""

from __future__ import annotations

from folioflow.llm.bpe import op6_byte_bpe
from folioflow.llm.chat import OP3_SQL, op3_chat_format
from folioflow.llm.collocations import OP11_SQL, op11_phrase_collocations
from folioflow.llm.decontamination import OP5_SQL, op5_spaced_seed_overlaps
from folioflow.llm.fingerprints import op13_document_fingerprints
from folioflow.llm.jaccard import op10_ngram_jaccard
from folioflow.llm.langid import op9_language
from folioflow.llm.licenses import OP4_SQL, op4_license_scan
from folioflow.llm.line_dedup import OP1_SQL, op1_line_dedup
from folioflow.llm.quality import op2_quality
from folioflow.llm.repair import OP12_SQL, op12_conversation_repair
from folioflow.llm.vectors import op8_near_vectors
from folioflow.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_spaced_seed_overlaps": op5_spaced_seed_overlaps,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_warc": op7_warc,
    "op8_near_vectors": op8_near_vectors,
    "op9_language": op9_language,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op5_spaced_seed_overlaps": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
