"""The registered queries of this folder and the SQL that must give the same rows."""

from __future__ import annotations

from panelwright.llm import alignment, collocations, exact, language, licenses, mixing, neighbours, packing, simhash, spans, suffixes, topk, toxicity
from panelwright.llm.tables import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary; the package that holds them stands on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeated_spans(spark, sf_dir):
    return spans.span_report(table(spark, sf_dir, "documents"))


def op3_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact.copy_groups(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def op12_embedding_near(spark, sf_dir):
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


REGISTERED = (
    op1_toxicity,
    op2_repeated_spans,
    op3_top_k,
    op4_pack,
    op5_license_scan,
    op6_language_id,
    op7_simhash,
    op8_suffix_dedup,
    op9_exact_dedup,
    op10_mix_sources,
    op11_cross_tokenizer,
    op12_embedding_near,
    op13_collocations,
)


def queries():
    return {f.__name__: f for f in REGISTERED}


def oracle_sql():
    """Where SQL can express the query."""
    return {
        "op2_repeated_spans": spans.SQL,
        "op3_top_k": topk.SQL,
        "op5_license_scan": licenses.SQL,
        "op9_exact_dedup": exact.SQL,
        "op10_mix_sources": mixing.SQL,
        "op13_collocations": collocations.SQL,
    }
