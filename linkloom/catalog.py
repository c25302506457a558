"""The named queries of the linkage engine, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .operators import experiments, models, rules
from .plans.decisions import QUERIES
from .plans.learned import LEARNED
from .plans.workspace import Workspace, oracle
from .sources import reports, tsv
from .streaming import incremental

_workspaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of a folder in this application; its stored relations serve all queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, folder)
    return _workspaces[key]


def forget() -> None:
    """Let the next query build its relations anew."""
    _workspaces.clear()


def _relation(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return workspace(spark, folder).relation(name)


def _other(build, spark: SparkSession, folder: str) -> DataFrame:
    return build(workspace(spark, folder))


#: Names of queries that show a relation in rounded or bare form.
RENAMED = {"norm_names": "norm_name", "norm_addrs": "norm_addr", "token_idf_table": "token_idf", "block_index_table": "block_index", "block_mass_table": "block_mass", "block_scores_table": "block_scores"}

#: Queries that are more than one relation.
OTHERS: dict[str, Callable[[Workspace], DataFrame]] = {
    "scan_tsv_roundtrip": tsv.roundtrip,
    "scan_json_roundtrip": reports.json_roundtrip,
    "scan_csv_roundtrip": reports.report_roundtrip,
    "stage1_scores": models.stage1_scores,
    "stage2_scores": models.stage2_scores,
    "feature_importances": models.importances,
    "pair_scorer": models.pair_scores,
    "choose_rule": rules.choose_rule,
    "learning_curve": experiments.learning_curve,
    "unseen_country": experiments.unseen_country,
    "feature_ablation": experiments.ablation,
    "stream_candidates": incremental.stream_candidates,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {RENAMED.get(n, n): partial(_relation, n) for n in (*QUERIES, *LEARNED)} | {n: partial(_other, f) for n, f in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    found = {n: oracle(n) for n in (*QUERIES, *LEARNED)}
    return {RENAMED.get(n, n): q for n, q in found.items() if q} | {"scan_tsv_roundtrip": oracle("source_rows"), "scan_json_roundtrip": oracle("learn_lexicon"), "scan_csv_roundtrip": oracle("threshold_sweep"), "stream_candidates": oracle("streamed")}
