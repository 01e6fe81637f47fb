"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import alignment, bpe, chains, counting, decontam, hardneg, licences, orderhash, packing, rules, simhash, suffixes, urls
from rankloom.llm.common import read

URL_ALLOW = ("com/", "www.example.com/en/")
URL_BLOCK = ("example.com/en/", "net/es/", "net/fr/")


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"), URL_ALLOW, URL_BLOCK)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = packing.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.digests(files)


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.counted(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(spark, read(spark, sf_dir, "documents"), length=400)


def op7_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = chains.learn(spark, docs, read(spark, sf_dir, "labels"), chains.toxicity_categories())
    return chains.judged(spark, docs, chain)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(spark, read(spark, sf_dir, "documents"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.classes(spark, read(spark, sf_dir, "documents"))


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mined(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(spark, read(spark, sf_dir, "documents"))


def op13_token_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.digests(spark, read(spark, sf_dir, "documents"), *files)


LLM_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_transducer": op1_bpe_transducer,
    "op2_url_filter": op2_url_filter,
    "op3_token_files": op3_token_files,
    "op4_decision_list": op4_decision_list,
    "op5_token_counts": op5_token_counts,
    "op6_repeated_strings": op6_repeated_strings,
    "op7_classifier_chain": op7_classifier_chain,
    "op8_license_scan": op8_license_scan,
    "op9_positional_index": op9_positional_index,
    "op10_order_minhash": op10_order_minhash,
    "op11_four_russians": op11_four_russians,
    "op12_deletion_variants": op12_deletion_variants,
    "op13_token_incidence": op13_token_incidence,
}
