"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .common import read_table
from .oracle import ORACLE_SQL  # noqa: F401

BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"


def op1_document_fingerprints(spark, sf_dir):
    from .fingerprints import neighbour_fingerprints

    return neighbour_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    from .quality_classifier import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_secret_scans(spark, sf_dir):
    from .secrets import secret_spans

    return secret_spans(read_table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN)


def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .byte_bpe import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN)


def op4_quality_rules(spark, sf_dir):
    from .quality_rules import quality_measures

    return quality_measures(read_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    from .preferences import answers_swapped, format_preferences

    return format_preferences(answers_swapped(read_table(spark, sf_dir, "conversations")))


def op8_license_scans(spark, sf_dir):
    from .licenses import license_labels

    return license_labels(read_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark, sf_dir):
    from .near_duplicates import near_duplicate_classes

    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_RANKS))


def op11_embedding_whitening(spark, sf_dir):
    from .whitening import whitened_components

    return whitened_components(read_table(spark, sf_dir, "embeddings"))


def op12_embedding_near_dedup(spark, sf_dir):
    from .near_vectors import near_vector_links

    return near_vector_links(read_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_quality_classifier,
        op3_secret_scans,
        op4_quality_rules,
        op5_packing,
        op6_byte_bpe,
        op7_chat_formatting,
        op8_license_scans,
        op9_minhash_near_dedup,
        op10_token_counts,
        op11_embedding_whitening,
        op12_embedding_near_dedup,
        op13_phrase_collocations,
    )
}