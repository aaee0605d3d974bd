"""The subpackage's registered queries and their check SQL."""

from __future__ import annotations

from huntframe.llm import chat_format, collocations, decontamination, quality, sharding, warc
from huntframe.llm.chat_format import op10_chat_format
from huntframe.llm.collocations import op12_collocations
from huntframe.llm.decontamination import op9_winnowing
from huntframe.llm.grouped_prefix_join import op8_grouped_prefix_join
from huntframe.llm.piece_encoding import op7_piece_encoding
from huntframe.llm.pii import op5_pii_spans
from huntframe.llm.quality import op3_quality_rules
from huntframe.llm.sharding import op4_slot_shards
from huntframe.llm.subword_classifier import op11_subword_classifier
from huntframe.llm.suffix_dedup import op6_suffix_dedup
from huntframe.llm.token_counts import op2_token_counts
from huntframe.llm.warc import op1_warc_archives
from huntframe.llm.whitening import op13_whitening

QUERIES = {
    "op1_warc_archives": op1_warc_archives,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_slot_shards": op4_slot_shards,
    "op5_pii_spans": op5_pii_spans,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_piece_encoding": op7_piece_encoding,
    "op8_grouped_prefix_join": op8_grouped_prefix_join,
    "op9_winnowing": op9_winnowing,
    "op10_chat_format": op10_chat_format,
    "op11_subword_classifier": op11_subword_classifier,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_warc_archives": warc.SQL,
    "op3_quality_rules": quality.SQL,
    "op4_slot_shards": sharding.SQL,
    "op9_winnowing": decontamination.SQL,
    "op10_chat_format": chat_format.SQL,
    "op12_collocations": collocations.SQL,
}
