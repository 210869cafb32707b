"""The corpus queries over the sample tables, and their SQL where there is any."""

from __future__ import annotations

from tenderloom.llm import (
    automata,
    exact,
    leaks,
    licenses,
    lines,
    mixing,
    near,
    quality,
    rules,
    suffixes,
    tokens,
    tries,
    whitening,
)
from tenderloom.llm.common import table


def op1_line_dedup(spark, sf_dir):
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark, sf_dir):
    return automata.without_earlier_spans(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffixes.without_repeated_bytes(table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark, sf_dir):
    return leaks.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(
        table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json"))
    )


def op10_quality_scores(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark, sf_dir):
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality_rules,
        op3_substring_dedup,
        op4_license_scan,
        op5_near_duplicates,
        op6_source_mix,
        op7_suffix_dedup,
        op8_benchmark_leaks,
        op9_token_counts,
        op10_quality_scores,
        op11_embedding_whitening,
        op12_exact_dedup,
        op13_conversation_trie,
    )
}
SQL: dict[str, str] = {
    "op1_line_dedup": lines.sql(),
    "op12_exact_dedup": exact.sql(),
    "op13_conversation_trie": tries.sql(),
}
