"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_quotes, collocations, decontamination, language_id, licence_scan, ngram_join, packing, quality_rules, suffix_dedup, token_counts, vector_codes, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_concat_and_cut": packing.query,
        "op2_latent_retrieval": decontamination.query,
        "op3_quotation_links": chat_quotes.query,
        "op4_length_histogram": token_counts.query,
        "op5_language_id": language_id.query,
        "op6_rule_ledger": quality_rules.query,
        "op7_index_family": suffix_dedup.query,
        "op8_licence_sentences": licence_scan.query,
        "op9_grouped_prefix_join": ngram_join.query,
        "op10_warc_chain": warc.query,
        "op11_vantage_codes": vector_codes.query,
        "op12_suffix_sigma": collocations.query,
        "op13_recursive_bpe": byte_bpe.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quotation_links": chat_quotes.ORACLE,
        "op6_rule_ledger": quality_rules.ORACLE,
        "op8_licence_sentences": licence_scan.oracle(),
        "op9_grouped_prefix_join": ngram_join.ORACLE,
        "op10_warc_chain": warc.ORACLE,
        "op11_vantage_codes": vector_codes.oracle(),
        "op12_suffix_sigma": collocations.ORACLE,
    }
