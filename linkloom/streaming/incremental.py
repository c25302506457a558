"""Linking a stream of new records of a source against the stored index of source 1: a stateless stream-static join."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..plans.relations import relation
from ..plans.workspace import shared_dir


@relation()
def streamed(d) -> str:
    """Each record of sources 2 and 3 with the records of source 1 that share indexed keys, and the weight they share."""
    return "SELECT country, src, num AS b_num, other AS s1_num, round(sn + sa, 6) AS score FROM @block_scores WHERE src <> 1"


def link_stream(keys: DataFrame, index: DataFrame, postings: DataFrame) -> DataFrame:
    """keys: a stream of (country, src, num, fam, key). Joins the index and the postings of source 1; pairs are added up within
    a micro-batch by foreach_batch()."""
    return keys.join(index, ["country", "fam", "key"]).join(postings, ["country", "fam", "key"]).selectExpr("country", "src", "num as b_num", "other as s1_num", "idf * idf as w")


def stream_candidates(ws) -> DataFrame:
    """The keys of sources 2 and 3 as a stream of files; each micro-batch writes its scored pairs to a folder of its own, so a
    batch that is replayed replaces what it wrote before."""
    spark, base = ws.spark, f"{shared_dir(ws.spark)}/linkloom-stream-{uuid.uuid4().hex}"
    keys = ws.relation("keys")
    # A file holds whole records, so a record's keys come in one micro-batch.
    keys.where("src <> 1").repartition(4, "country", "src", "num").write.parquet(f"{base}/in")
    index = ws.relation("block_index").where("src = 1").select("country", "fam", "key", "idf")
    postings = keys.where("src = 1").selectExpr("country", "fam", "key", "num as other")

    def batch(df: DataFrame, which: int) -> None:
        scored = df.groupBy("country", "src", "b_num", "s1_num").agg({"w": "sum"}).withColumnRenamed("sum(w)", "score")
        scored.where("score > 0").selectExpr("country", "src", "b_num", "s1_num", "round(score, 6) as score").write.mode("overwrite").parquet(f"{base}/out/batch={which}")

    stream = link_stream(spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"), index, postings)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("country string, src long, b_num long, s1_num long, score double, batch long").parquet(f"{base}/out").drop("batch")
