"""The queries of this subpackage, and the SQL that gives their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import oracles
from cardloom.llm.common import table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "pieces")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cardloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.toxicity import CATEGORIES, classify, fit, label_columns

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, label_columns(table(spark, sf_dir, "labels")), CATEGORIES))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.url_filters import filter_urls

    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.decontaminate import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.topk import quantised, top_k

    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.pii import pseudonymise, session_key

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), spans=True)


def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cardloom.llm.bpe_lexicon import digests, encode_texts

    return digests(encode_texts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), decoded=True))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.periodic_runs import digests, periodic_runs, planted

    return digests(periodic_runs(table(spark, sf_dir, "documents"), words_of=planted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_secret_links": op10_secret_links,
    "op11_filter_audit": op11_filter_audit,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_periodic_runs": op13_periodic_runs,
}

#: The others need functions that SQL lacks (XXH64, tokenizers, trained models, keyed permutations, seeded draws).
ORACLE: dict[str, str] = {
    "op5_url_filters": oracles.URLS,
    "op7_substring_dedup": oracles.SUBSTRINGS,
    "op8_exact_top_k": oracles.TOP_K,
    "op10_secret_links": oracles.SECRETS,
    "op11_filter_audit": oracles.AUDIT,
    "op13_periodic_runs": oracles.RUNS,
}
