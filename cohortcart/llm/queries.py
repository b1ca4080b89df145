"""The registered queries of the training-data operators: one per operator, over whole tables.

Each query applies its operator with production settings and derives the digest columns
from the operator's real output.  ``oracle_sql`` holds the DuckDB twin where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcart.llm import fill_middle, licenses, vector_codes, warc
from cohortcart.llm.fill_middle import digests, fill_in_middle
from cohortcart.llm.licenses import find_licenses
from cohortcart.llm.lm_scoring import language_model_scores
from cohortcart.llm.mixing import fit_mixture, with_copies
from cohortcart.llm.nearest import nearest_neighbours
from cohortcart.llm.packing import pack
from cohortcart.llm.pii import personal_data, span_digests
from cohortcart.llm.quality_classifier import quality_scores
from cohortcart.llm.quality_rules import quality_rules
from cohortcart.llm.sharding import LAW, row_size, write_shards
from cohortcart.llm.simhash import near_duplicates
from cohortcart.llm.warc import page_records, read_archives, write_archives
from cohortcart.session import scratch_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ids may repeat, so a row's key is its place in the stored table as well
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    shards = write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), shards=16,
                          row_key=[F.col("doc_id"), *place])
    text = F.col("record.text")
    return shards.select(
        F.col("record.doc_id").alias("doc_id"), row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = with_copies(docs, fit_mixture(docs))
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return page_records(read_archives(spark, path))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(personal_data(table(spark, sf_dir, "documents")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_quality_classifier, op3_sharding, op4_mixing, op5_lm_scoring, op6_licenses, op7_simhash, op8_nearest,
                                     op9_quality_rules, op10_warc, op11_vector_codes, op12_pii, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses.oracle(), "op10_warc": warc.oracle(),
            "op11_vector_codes": vector_codes.oracle(), "op13_fill_middle": fill_middle.oracle()}
