"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm import fim, language, lexical, mixing, neardup, neighbours, pieces, quality, repeats, secrets, url_filter, vector_groups, warc
from noticeloom.llm.common import table
from noticeloom.llm.oracles import ORACLES as ORACLES


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    # a revisit's length and digest are those of the payload that it stands for
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "rate")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.ruled_outcomes(pages)).select("page_id", "host", "path", "rule", "verdict")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.repeated_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups.grouped(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_secret_scan": op2_secret_scan,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_groups": op12_vector_groups,
    "op13_ranked_search": op13_ranked_search,
}
