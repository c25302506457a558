"""What the operators of this subpackage share: tables, scratch tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of variable-length values in one Arrow batch that an operator hands back to Spark.
OUT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The cluster names it in spark.checkpoint.dir; only where that is unset
    (tests on one machine) does this choose one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir("file:///tmp/checkpoints/linkloom")
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs
    only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/linkloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Delete what an action has shuffled as soon as it ends, not when the driver next collects garbage: for tables that are
    written once and then read from their files."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lean(df: DataFrame) -> DataFrame:
    """df, in a session that sends texts to Python in batches of at most 8 MB: rows can be long, and a task holds a batch
    several times over. These two settings stay as they are set here, since plans run after this returns."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def batched(rows: Iterator[tuple], schema: pa.Schema, weigh: int | None = None, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches. weigh: index of the value whose length counts against OUT_BYTES."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        if weigh is not None:
            size += len(row[weigh])
        if len(held) >= most or size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def signed(h: int) -> int:
    """A 64-bit hash as Spark's long."""
    return h - (1 << 64) if h >> 63 else h
