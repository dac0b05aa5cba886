"""The registered queries of this sub-package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, embeddings, html, licenses, mixing, neardup, packing, pii, quality, substring, suffixes, tokenfile, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html.html_query,
    "op2_substring_dedup": substring.substring_query,
    "op3_near_dedup": neardup.near_query,
    "op4_suffix_dedup": suffixes.suffix_query,
    "op5_token_files": tokenfile.token_query,
    "op6_embedding_dedup": embeddings.embedding_query,
    "op7_pack": packing.pack_query,
    "op8_license_scan": licenses.license_query,
    "op9_mix_sources": mixing.mix_query,
    "op10_quality_rules": quality.quality_query,
    "op11_centroid_clusters": centroids.centroid_query,
    "op12_conversation_trie": trie.trie_query,
    "op13_personal_data": pii.pii_query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring.SUBSTRING_SQL,
    "op6_embedding_dedup": embeddings.EMBEDDING_SQL,
    "op8_license_scan": licenses.license_sql(),
    "op9_mix_sources": mixing.MIX_SQL,
    "op11_centroid_clusters": centroids.CENTROID_SQL,
    "op12_conversation_trie": trie.TRIE_SQL,
}
