"""JSON tables for learned maps and decisions, CSV tables for reports. All are written by the executors and read with a schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAP = "country string, tok string, repl string"
DECISION = "rule string, setting double, f05 double"


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; a null is a missing field."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; a line that isn't JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """country, tok, repl of one JSON document {country: {token: replacement}}, or of {token: replacement} with null countries.
    Such a document is a caller's own map and is parsed as one value; maps learned here are JSON lines."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "map<string,map<string,string>>")
    flat = F.from_json("value", "map<string,string>")
    parts = text.select(F.explode(nested).alias("country", "inner")).select("country", F.explode("inner").alias("tok", "repl"))
    plain = text.select(F.explode(flat).alias("tok", "repl")).where(~F.ltrim("repl").startswith("{"))
    return parts.unionByName(plain.select(F.lit(None).cast("string").alias("country"), "tok", "repl"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header="true", quote='"', escape='"', nullValue="").csv(path)


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(header="true", quote='"', escape='"', nullValue="", mode="FAILFAST").csv(path)


def _path(ws, name: str) -> str:
    from ..plans.workspace import shared_dir

    return f"{shared_dir(ws.spark)}/linkloom-{name}-{uuid.uuid4().hex}"


def json_roundtrip(ws) -> DataFrame:
    """The learned lexicon, written as JSON and read back."""
    rows, path = ws.relation("learn_lexicon"), _path(ws, "json")
    write_json(rows, path)
    return read_json(ws.spark, path, rows.schema)


def report_roundtrip(ws) -> DataFrame:
    """The sweep of thresholds, written as a CSV report and read back."""
    rows, path = ws.relation("threshold_sweep"), _path(ws, "csv")
    write_report(rows, path)
    return read_report(ws.spark, path, rows.schema)
