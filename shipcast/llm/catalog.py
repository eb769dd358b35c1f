"""Queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from . import (
    bitpack,
    hash_forest,
    multi_index,
    nbest,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    spotsigs,
    suffix_tree,
    token_counts,
    zone_clusters,
)

QUERIES = {
    "op1_packed_token_ids": bitpack.query,
    "op2_simhash_groups": simhash.query,
    "op3_compression_quality": quality_classifier.query,
    "op4_token_counts": token_counts.query,
    "op5_uniform_shards": sharding.query,
    "op6_packed_sequences": packing.query,
    "op7_spot_signatures": spotsigs.query,
    "op8_suffix_tree_scores": suffix_tree.query,
    "op9_nbest_segmentations": nbest.query,
    "op10_quality_rules": quality_rules.query,
    "op11_hash_forest": hash_forest.query,
    "op12_zone_clusters": zone_clusters.query,
    "op13_hard_negatives": multi_index.query,
}
ORACLE: dict[str, str] = {
    "op10_quality_rules": quality_rules.ORACLE_SQL,
}
