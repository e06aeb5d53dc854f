"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality
from .alignment import align
from .common import held_out, table
from .decontaminate import contaminated
from .fingerprint import fingerprints_with_next
from .inner_product import top_inner_products
from .lexical import ranked_documents
from .mixing import cyclic_weights, mix_sources
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_binary import read_token_files, write_token_files
from .token_counts import token_counts
from .warc import read_warc, resolve_revisits, write_warc


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~held_out("doc_id")))
    return language_id.identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return quality.score(docs, model, threshold=0.3).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), cyclic_weights((3, 1, 2)), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=0.5, overlap=0.5)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(resolve_revisits(table(spark, sf_dir, "pages"), min_bytes=0))
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
