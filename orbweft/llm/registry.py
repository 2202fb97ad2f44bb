"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from orbweft.llm import bpe, dedup, hilbert, jaccard, language, mpegts, order, packing, quality, warc

QUERIES = {
    "op1_bpe_codec": bpe.op1_bpe_codec,
    "op2_fuse_dedup": dedup.op2_fuse_dedup,
    "op3_language_svm": language.op3_language_svm,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_training_order": order.op5_training_order,
    "op6_hilbert_shards": hilbert.op6_hilbert_shards,
    "op7_vector_packing": packing.op7_vector_packing,
    "op8_quality_neighbours": quality.op8_quality_neighbours,
    "op9_mpegts_media": mpegts.op9_mpegts_media,
    "op10_warc_normaliser": warc.op10_warc_normaliser,
}
ORACLES = {
    "op2_fuse_dedup": dedup.OP2_SQL,
    "op4_ngram_jaccard": jaccard.OP4_SQL,
    "op10_warc_normaliser": warc.OP10_SQL,
}
