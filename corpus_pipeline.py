"""The corpus pipeline: five stages over ``documents``, each over all that the one before kept.

toxicity drops documents with a score of 0.7 or more (a null doc_id is a document as any); line
dedup drops lines that came before, and documents that had lines and have none left; the n-gram join
keeps one row of each component, of the least doc_id (null last) and then the least hash of all
columns, and every row without words; mixing keeps documents whole, each as often as its words are
taken on average, rounded up or down (0 to 2 copies, so clean documents go where a source's target
is below its size) such that a source's words come near its target, and drops documents without
words; packing returns pieces of sequences. All but packing return the columns of documents. Empty
tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvec.llm.line_dedup import dedup_lines
from cellvec.llm.mixing import copy_documents
from cellvec.llm.ngram_join import link_rows
from cellvec.llm.packing import pack_documents
from cellvec.llm.scratch import Scratch
from cellvec.llm.toxicity import THRESHOLD, toxicity_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.filter(toxicity_column(spark, docs, labels) < THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"))
    key = F.sha2(F.to_json("row"), 256).alias("key")
    x = rows.select(F.col("row").getField("doc_id").alias("doc_id"), F.col("row").getField("text").alias("text"), key)
    held = link_rows(spark, x, keep=("key",)).filter("component is not null").groupBy("component", "key").agg(F.min("doc_id").alias("id"), F.count("*").alias("held"))
    held = Scratch(spark, "one-of-each").keep(held, "held")
    best = held.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("best"))
    marks = held.join(best, "component").select("key", (F.col("best.key") != F.col("key")).alias("gone"), "held").filter("gone or held > 1").drop("held")
    x = rows.withColumn("key", key).join(marks, "key", "left")
    once = x.filter("not gone").dropDuplicates(["key"])  # rows alike in all columns
    return x.filter("gone is null").union(once).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copy_documents(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(spark, docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram jaccard join", one_of_each), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack)]

#: Compression lengths, MinHash and token ids are beyond SQL; the tests of this module hold the n-gram join, the mixing
#: and the whole run against brute force on small tables, those of cellvec.llm the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    spent: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(*spent)  # nothing reads the stage before any more
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
