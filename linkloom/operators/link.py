"""Linking three sources: the plan over a caller's own tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..plans.workspace import Workspace, shared_dir
from ..sources.tsv import as_raw


class Linker:
    """Links records of s1 to those of s2 and s3 (columns entity_id, business_name, business_address, country).

    truth (s1_num, src, b_num) is optional. Every relation of the plan is there by name: candidates, pair_features_tokens,
    competition_features, one_owner, decide_threshold, result_table, macro_f05 and so on. Only countries that s1 has are
    linked; records of s1 without a country have no candidates and an empty result."""

    def __init__(self, spark: SparkSession, s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame | None = None, config: LinkConfig | None = None):
        self.workspace = Workspace(spark, "", config=config)
        rows = as_raw(s1, 1)
        countries = rows.select("country").where("country is not null").distinct()
        others = as_raw(s2, 2).unionByName(as_raw(s3, 3)).join(countries, "country", "left_semi").select(*rows.columns)
        raw = rows.unionByName(others)
        self.workspace.give("raw", raw)
        if truth is None:
            truth = spark.createDataFrame([], "s1_num long, src long, b_num long")
        self.workspace.give("truth", truth.join(rows.select(F.col("num").alias("s1_num"), "country"), "s1_num").select("country", "s1_num", "src", "b_num"))

    def relation(self, name: str) -> DataFrame:
        return self.workspace.relation(name)

    def learned(self) -> Linker:
        """A linker of the same sources whose records have the learned maps applied. What it learned from is written first;
        replacements that a caller gives (fixed_tokens, fixed_addr_tokens) go to this one's workspace before."""
        out = object.__new__(Linker)
        ws = self.workspace
        out.workspace = Workspace(ws.spark, ws.folder, ws.tables, ws.config)
        for name in ("raw", "truth"):
            out.workspace.give(name, ws.relation(name))
        path = f"{shared_dir(ws.spark)}/linkloom-learned-{uuid.uuid4().hex}"
        rows = ws.relation("mapped_records")
        rows.write.parquet(path)
        out.workspace.give("records", ws.spark.read.schema(rows.schema).parquet(path))
        return out

    def result(self) -> DataFrame:
        return self.relation("result_table")
