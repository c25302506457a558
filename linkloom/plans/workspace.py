"""Builds relations on Spark, and their oracle texts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import LinkConfig, using
from ..functions import fold
from . import decisions, learned  # noqa: F401  (add their relations)
from .dialect import ORACLE, SPARK
from .relations import RELATIONS, SPARK_ONLY, STORED

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
NAME = re.compile(r"@(\w+)")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; chosen here only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints/linkloom")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Workspace:
    """Relations over the tables of one folder. Stored ones are written once for the life of the workspace."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, DataFrame] | None = None, config: LinkConfig | None = None):
        self.spark, self.folder, self.tables, self.config = spark, folder, tables or {}, config or LinkConfig()
        self.mark = uuid.uuid4().hex[:8]
        self.built: dict[str, DataFrame] = {}
        fold.register(spark)

    def _view(self, name: str) -> str:
        return f"linkloom_{name}_{self.mark}"

    def table(self, name: str) -> str:
        if name not in self.built:
            df = self.tables.get(name)
            self.built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet") if df is None else df
            self.built[name].createOrReplaceTempView(self._view(name))
        return self._view(name)

    def give(self, name: str, df: DataFrame) -> None:
        """Use df as a relation."""
        df.createOrReplaceTempView(self._view(name))
        self.built[name] = df

    def relation(self, name: str) -> DataFrame:
        if name not in self.built:
            with using(self.config):
                text = RELATIONS[name](SPARK)
            df = self.sql(text)
            if name in STORED:
                return self.store(name, df)
            self.give(name, df)
        return self.built[name]

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """Write df to the shared folder, and use it as a relation from there."""
        path = f"{shared_dir(self.spark)}/linkloom-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.give(name, self.spark.read.schema(df.schema).parquet(path))
        return self.built[name]

    def sql(self, text: str) -> DataFrame:
        """A query over relations (@name) and tables (by name)."""

        def use(m):
            self.relation(m[1])
            return self._view(m[1])

        text = NAME.sub(use, text)
        for t in TABLES:
            text = re.sub(rf"\bFROM {t}\b", lambda m, t=t: f"FROM {self.table(t)}", text)
        return self.spark.sql(text)


def oracle(name: str) -> str | None:
    """The relation as one oracle query, or None where it uses what only Spark has."""
    order: list[str] = []

    def visit(r: str) -> bool:
        if r in order:
            return True
        if r in SPARK_ONLY:
            return False
        if not all(visit(x) for x in NAME.findall(RELATIONS[r](ORACLE))):
            return False
        order.append(r)
        return True

    if not visit(name):
        return None
    parts = ", ".join(f"{r} AS {'MATERIALIZED ' if r in STORED else ''}({NAME.sub(r'\1', RELATIONS[r](ORACLE))})" for r in order)
    return f"WITH {parts} SELECT * FROM {name}"
