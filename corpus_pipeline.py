"""Corpus pipeline: each stage reads what its predecessor wrote.

The stages run over whole texts of all rows they are given; all but the last return
the columns of ``documents``. Each decides row by row: rows that share an id, or have a
null one, are told apart by their texts. Null and empty texts are texts without words,
which no stage but mixing leaves out (they have nothing to take); an empty table passes
as one; columns beside those of ``documents`` are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import delete, materialize, new_path
from blocklens.llm.decontaminate import rows_with_hits
from blocklens.llm.mixing import mixed_documents
from blocklens.llm.ngram_join import ngram_components
from blocklens.llm.queries import fold, table, vocabulary
from blocklens.llm.toxicity import scored_rows
from blocklens.llm.wavelet import encode_and_read_back

NEAR = {"k": 5, "num": 4, "den": 5}


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows beyond the threshold calibrated for their language go; the fit reads the labelled rows of ``docs``."""
    scored = scored_rows(docs, table(spark, sf_dir, "labels"), fold() != 1)
    return scored.filter("NOT __toxic").select(*own_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of the least id (null last), then text hash.

    Rows are named by a hash of id and text; rows equal in both are one, and stay once.
    """
    named = docs.withColumn("__name", F.xxhash64("doc_id", "text"))
    found = ngram_components(named, id_col="__name", **NEAR).select(F.col("doc_id").alias("__name"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__name")
    first = named.select("__name", "doc_id").join(found.distinct(), "__name").groupBy("component_id").agg(F.min(order).alias("first"))
    first = materialize(first.select(F.col("first.doc_id").alias("__id"), F.col("first.__name").alias("__first")), "first")
    kept = named.join(first, (named["__name"] == first["__first"]) & named["doc_id"].eqNullSafe(first["__id"]), "left_semi")
    return kept.dropDuplicates(["__name", "doc_id"]).select(*own_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of the benchmark go."""
    return rows_with_hits(docs, table(spark, sf_dir, "benchmark")).filter(F.size("__items") == 0).select(*own_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers in wavelet shards, read back per row."""
    return encode_and_read_back(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: A classifier and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the one after it has read it."""
    base, read = new_path(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if read:
            delete(spark, read)
        read = f"{base}/{name}"
    return docs
