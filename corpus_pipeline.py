"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of near-duplicates one row with the smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: each source is brought to its target number of words; a document stands once for each of its copies.
5. token_ids: the documents' token ids are written to files in id order; the result lists what the files hold.

Every stage decides about all rows that its predecessor kept and returns the columns of documents (the last one: doc_id,
start, n_tokens, ids_crc32). A stage decides by row, not by id, so rows with a null or repeated doc_id are judged like any
other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import quality
from weftline.llm.common import held_out, table, written
from weftline.llm.decontaminate import contaminated
from weftline.llm.mixing import cyclic_weights, mix_sources
from weftline.llm.simhash import similar_groups
from weftline.llm.token_binary import read_token_files, write_token_files


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of the documents that this stage gets, and keep what the model doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return quality.keep(docs, model, threshold=0.3)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of a stage's own, which the documents don't have, whatever columns they have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _rows(docs: DataFrame, row: str) -> DataFrame:
    """The stage's rows, each with a key of its own, which is written so that it stays."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a similarity of 0.8. Of a group's rows one with the smallest id stays, of null ids only if there is no other.

    Rows are told apart by text and id, so that no table of all texts has to be written; of rows that share both any one
    stays. Null texts count as empty ones.
    """
    key, stays, of_id = _free(docs, "text_key", "stays", "of_id")
    of_text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    found = similar_groups(docs.withColumn(key, of_text), shingle=5, id_col=key).select(F.col(key).alias("text_key"), "component_id").distinct()
    rows = docs.select(of_text.alias("k"), F.col("doc_id").alias("id")).groupBy("k", "id").agg(F.count("*").alias("n"))
    rows = rows.join(found, F.col("k") == F.col("text_key"))
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k", "n")).alias("first"))
    first = written(first.select(F.col("first.k").alias(stays), F.col("first.id").alias(of_id), F.col("first.n").alias("n")), "pipeline-first")
    repeated = written(first.filter("n > 1").drop("n"), "pipeline-repeated")
    here = lambda them: (of_text == them[stays]) & docs["doc_id"].eqNullSafe(them[of_id])
    once = first.filter("n = 1").drop("n")
    again = docs.join(repeated, here(repeated)).dropDuplicates([stays]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.join(once, here(once), "left_semi").union(again)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a text holds is the same for all its rows, so rows are told apart by their text, whatever their ids."""
    key, gone = _free(docs, "text_key", "gone")
    of_text = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    found = contaminated(docs.withColumn(key, of_text), table(spark, sf_dir, "benchmark"), id_col=key)
    found = written(found.select(F.col(key).alias(gone)), "contaminated").distinct()
    return docs.join(found, of_text == F.col(gone), "left_anti")


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    row, of_row, copies, copy = _free(docs, "row", "of_row", "copies", "copy")
    docs = _rows(docs, row)
    mixed = mix_sources(docs, cyclic_weights((3, 1, 2)), share=1.5, cap=2.0, id_col=row, by=("doc_id", "text"))
    mixed = mixed.filter("copies > 0").select(F.col(row).alias(of_row), F.col("copies").alias(copies))
    taken = docs.join(mixed, F.col(row) == F.col(of_row))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in columns])


def _token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("decontamination", _decontamination), ("mixing", _mixing), ("token_ids", _token_ids)]

#: A classifier's model, XXH3, BM25 retrieval, Newton's method and a tokenizer can't be put in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
