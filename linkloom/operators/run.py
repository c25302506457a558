"""The whole linkage as steps, with a gate on recall, logs, and outputs by country that can be replaced one at a time."""

from __future__ import annotations

import logging
import time

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame

LOG = logging.getLogger("linkloom")
STEPS = ("records", "candidates", "pair_features", "predicted", "decide_threshold", "result_table")


def save_models(models: list, folder: str) -> None:
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{folder}/model-{k}")


def load_models(folder: str, n: int) -> list:
    return [GBTClassificationModel.load(f"{folder}/model-{k}") for k in range(n)]


def write_by_country(df: DataFrame, path: str) -> None:
    """Replace the countries that df has; leave others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)


def finished(spark, path: str) -> list[str]:
    """Countries that a folder of write_by_country() has."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted(unescape(n.removeprefix("country=")) for n in names if n.startswith("country="))


def write_missing(df: DataFrame, path: str, again: tuple[str, ...] = ()) -> list[str]:
    """Write the countries that path lacks, and those named in `again`; the others are reused. Rows without a country are
    written each time. Returns the reused ones."""
    reused = [c for c in finished(df.sparkSession, path) if c not in again and c != "__HIVE_DEFAULT_PARTITION__"]
    write_by_country(df.where(~df["country"].isin(reused) | df["country"].isNull()) if reused else df, path)
    return reused


def recall_gate(ws, least: float) -> bool:
    """Whether blocking finds more than `least` of the true pairs; without any, the gate is open."""
    r = ws.relation("block_recall").first()
    LOG.info("recall %s of %s pairs, %s candidates a record", r.recall, r.n_true, r.per_s1)
    return r.recall is None or r.recall > least


def run(ws, out: str, first: str = STEPS[0], least_recall: float = 0.9, reuse: bool = False, again: tuple[str, ...] = ()) -> dict[str, float]:
    """Write each step's relation from `first` on to out; seconds by step. Stops before features if the gate is shut. reuse:
    leave the countries that out has, but for those in `again`, which are written anew."""
    took = {}
    for step in STEPS[STEPS.index(first) :]:
        t = time.perf_counter()
        df = ws.relation(step)
        if step == "pair_features" and not recall_gate(ws, least_recall):
            raise RuntimeError("too few true pairs among the candidates")
        if "country" in df.columns:
            (write_missing(df, f"{out}/{step}", again) if reuse else write_by_country(df, f"{out}/{step}"))
        else:
            df.write.mode("overwrite").parquet(f"{out}/{step}")
        took[step] = time.perf_counter() - t
        LOG.info("%s: %.1f s", step, took[step])
    return took
