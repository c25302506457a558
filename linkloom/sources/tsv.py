"""Tab-separated sources and sinks of a linkage run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COLUMNS = ("entity_id", "business_name", "business_address", "country")
SCHEMA = StructType([StructField(c, StringType()) for c in COLUMNS])
# Texts that count as missing when a source is read.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORMAT = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "false"}


def read_source(spark: SparkSession, path: str, columns=COLUMNS) -> DataFrame:
    """Records of a source as texts; MISSING texts become null. columns: those to read."""
    df = spark.read.schema(SCHEMA).options(**FORMAT).csv(path)
    return df.select(*[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in columns])


def read_split(spark: SparkSession, folder: str, split: str) -> dict[str, DataFrame]:
    return {f"s{k}": read_source(spark, f"{folder}/{split}_source{k}.tsv") for k in (1, 2, 3)}


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_num, src, b_num of the true pairs; a record with an empty list has none."""
    schema = StructType([StructField("source1_entity_id", StringType()), StructField("matched_entity_ids", StringType())])
    rows = spark.read.schema(schema).options(**FORMAT).csv(path).where("matched_entity_ids <> ''")
    ids = rows.select(F.substring("source1_entity_id", 4, 20).cast("long").alias("s1_num"), F.explode(F.split("matched_entity_ids", ",")).alias("id"))
    return ids.select("s1_num", F.substring("id", 2, 1).cast("long").alias("src"), F.substring("id", 4, 20).cast("long").alias("b_num"))


def write_table(df: DataFrame, path: str) -> None:
    """A result table, one row for each record of source 1."""
    df.write.mode("overwrite").options(sep="\t", header="true", quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def as_raw(source: DataFrame, src: int) -> DataFrame:
    """Source records as the plan's raw relation: num, country, src, name, address."""
    return source.select(F.substring("entity_id", 4, 20).cast("long").alias("num"), "country", F.lit(src).cast("long").alias("src"), F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"))


def roundtrip(ws) -> DataFrame:
    """The fixture's sources, written as tab-separated text and read back."""
    from ..plans.workspace import shared_dir

    rows = ws.relation("source_rows")
    path = f"{shared_dir(ws.spark)}/linkloom-tsv-{uuid.uuid4().hex}"
    write_table(rows.select(*COLUMNS), path)
    return read_source(ws.spark, path)
