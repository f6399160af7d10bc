"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id as lid
from . import license_scan as lic
from . import near_duplicates as near
from . import packing
from . import pitman_yor
from . import posting_lists
from . import private_data as private
from . import quality_rules as quality
from . import shuffle_shards as shards
from . import subword
from .common import read_table


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shuffle_shards(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read_table(spark, sf_dir, "documents"), k=2)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.pitman_yor_scores(read_table(spark, sf_dir, "documents"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents")).drop("rule")


def op6_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_maxplus_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.subword_ids(read_table(spark, sf_dir, "documents"))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lic.license_scan(read_table(spark, sf_dir, "documents"))


def op9_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lid.identify_language(read_table(spark, sf_dir, "documents"))


def op10_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_data(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_posting_lists, op2_feistel_shards, op3_lsh_forest, op4_pitman_yor, op5_quality_cascade, op6_island_packing, op7_maxplus_subword, op8_license_rules, op9_ecoc_language, op10_disclosure_pii)}
ORACLES: dict[str, str] = {"op3_lsh_forest": near.ORACLE, "op5_quality_cascade": quality.ORACLE, "op8_license_rules": lic.oracle()}
