"""A corpus pipeline: STAGES applied one after the other to the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Rows with a null doc_id pass the stages that compare documents. Language ID can't be
said in SQL, so ORACLE_SQL is None, and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlescan.llm import bpe, decontaminate, jaccard, language, line_dedup
from bundlescan.llm.common import written
from bundlescan.llm.queries import table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without text or letters go."""
    model = language.train(docs, F.col("lang").isNotNull())
    return language.predict(docs, model).filter(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents repeat."""
    out = line_dedup.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies -- five words, similarity 0.8 --, the one with the
    smallest id. Rows that repeat an id and its text are one; an id's rows with other texts all stay
    or go with it. The copies are found where the join has put them, without another exchange."""
    kept = (jaccard.similar_groups(docs, n=5, percent=80).filter(F.col("doc_id") == F.col("component_id"))
            .select("doc_id").distinct())
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.verdict(found).filter(~F.col("contaminated")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids as little-endian unsigned 32-bit integers, and the digest of what they
    decode to."""
    back = bpe.encode(docs, *tokenizer(), decoded="decoded", keep=["doc_id", "lang", "source"])
    return back.select("doc_id", "lang", "source", "token_ids", F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("ngram_jaccard_join", near_duplicates),
          ("decontamination", decontamination), ("byte_bpe", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
