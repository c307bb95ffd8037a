"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    common, embedding_dedup, language_id, license_scan, merkle, minhash_dedup, mixing, packing, secret_scan, spelling, token_count,
    topk_search,
    substring_dedup, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark, sf):
    docs = common.table(spark, sf, "documents")
    return language_id.identify(docs, common.remainder("doc_id", 4) != 2)


@query
def op8_secret_scan(spark, sf):
    return secret_scan.digest(secret_scan.scan_secrets(common.table(spark, sf, "documents")))


@query
def op9_token_count(spark, sf):
    return token_count.count_tokens(common.table(spark, sf, "documents"))


@query
def op3_mixing(spark, sf):
    mixed = mixing.mix(common.table(spark, sf, "documents"))
    return mixed.drop("source", "taking")


@query
def op6_packing(spark, sf):
    return packing.pack(common.table(spark, sf, "documents"))


@query
def op4_minhash_dedup(spark, sf):
    return minhash_dedup.near_duplicates(common.table(spark, sf, "documents"), k=4)


@query
def op5_topk_search(spark, sf):
    return topk_search.top_k(common.table(spark, sf, "embeddings"), F.col("key") % 100 == 0)


@query
def op7_embedding_dedup(spark, sf):
    return embedding_dedup.near_vectors(common.table(spark, sf, "embeddings"))


@query
def op10_toxicity(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    return toxicity.score(docs, labels, common.remainder("doc_id", 3) != 1)


@query
def op2_substring_dedup(spark, sf):
    return substring_dedup.repeated_passages(common.table(spark, sf, "documents"))


@query
def op11_merkle_manifest(spark, sf):
    docs = common.table(spark, sf, "documents")
    tampered = F.when(common.remainder("doc_id", 2) == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, tampered)


@query
def op12_spelling_variants(spark, sf):
    return spelling.variants(spelling.word_counts(common.table(spark, sf, "documents")), ratio=10, min_length=7)


@query
def op13_license_scan(spark, sf):
    return license_scan.scan_licenses(common.table(spark, sf, "documents"))
