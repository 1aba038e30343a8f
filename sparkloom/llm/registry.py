"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from .centroid_clusters import op13_centroid_clusters, op13_sql
from .chat_format import OP4_SQL, op4_chat_format
from .jaccard_join import op3_ngram_jaccard_join
from .language_id import op7_language_id
from .line_dedup import OP12_SQL, op12_line_dedup
from .merkle_manifest import OP11_SQL, op11_merkle_manifest
from .pii import op5_pii_surrogates
from .quality_model import op9_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .sentencepiece_codec import op6_sentencepiece
from .source_mix import op2_source_mix
from .url_filter import op1_sql, op1_url_filter
from .vector_dedup import op8_embedding_near_dedup

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mix": op2_source_mix,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_chat_format": op4_chat_format,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_dedup": op12_line_dedup,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": op1_sql(),
    "op4_chat_format": OP4_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_centroid_clusters": op13_sql(),
}
