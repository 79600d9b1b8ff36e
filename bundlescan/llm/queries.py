"""The registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlescan.llm import (
    bpe, collocations, decontaminate, html, jaccard, language, line_dedup, ngram_lm, oracles, packed_ids, ranked_search, substrings,
    vectors, warc)
from bundlescan.llm.common import mounted, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """The rank file and the pattern of the public byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.encode(docs, *tokenizer(), decoded="decoded", keep=["doc_id"])
    return back.select("doc_id", F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdict(decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = (table(spark, sf_dir, "documents").select("doc_id", "text")
            .withColumn("held_out", F.coalesce(ngram_lm.fold(F.col("doc_id"), 7) == 2, F.lit(False))))
    model = ngram_lm.train(docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return ngram_lm.score(docs, model, keep=["doc_id", "held_out"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(ngram_lm.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language.train(docs, ~held_out)
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=["doc_id", "held_out"])


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder).count()
    return warc.read(spark, f"file://{mounted(folder)}", payloads=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op11_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = scratch(spark, "ids8b")
    packed_ids.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return packed_ids.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


REGISTRY = {f.__name__: (f, oracles.SQL.get(f.__name__)) for f in (
    op1_byte_bpe, op2_decontaminate, op3_substring_dedup, op4_ngram_lm, op5_language_id, op6_main_text, op7_warc,
    op8_near_vectors, op9_line_dedup, op10_jaccard_join, op11_packed_ids,
    op12_ranked_search, op13_collocations)}
