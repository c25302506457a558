"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Targets: every source gets its weight's share of a budget of words, stops at a cap (its size times the epochs allowed), and
the excess is shared again by weight until none is above: water filling, solved in closed form over the table of sources.
Order: the documents of a source stand in the order of a seeded digest. Their cumulative sizes come from totals of digest
buckets (one row per source and bucket) plus a running sum within a bucket, so a source that holds a third of all rows is
spread over all buckets. Curriculum: a source's weight changes over training time; the integral of its schedule is the
cumulative demand for its words, and the inverse of that integral, taken at a document's cumulative size, is the position in
training at which the document is read. The result is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lean, materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: (time, weight) knots of a source's schedule, by the source's place in the cycle of weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def _integral(knots) -> list[tuple[float, float, float, float, float]]:
    """Segments (start, length, weight at the start, slope, integral up to the start), scaled so that the whole integral is 1."""
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
        out.append([t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), total])
        total += (w0 + w1) / 2 * (t1 - t0)
    return [(t, n, w / total, m / total, d / total) for t, n, w, m, d in out]


def invert_schedule(share: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear weight reaches share (0 to 1) of the whole."""
    found: Column | None = None
    for t, _, w, m, d in _integral(knots):
        y = share - F.lit(d)
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2.0 * m) * y, F.lit(0.0)))
        at = F.lit(t) + F.coalesce(F.try_divide(F.lit(2.0) * y, F.lit(w) + root), F.when(y.isNotNull(), F.lit(0.0)))
        found = at if found is None else F.when(share >= F.lit(d), at).otherwise(found)
    return found


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row for each source: source, place, source_size, target. Sources in code point order, null last, weigh weights in
    turn; the window runs over one row per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    every = Window.partitionBy()
    rows = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    rows = rows.withColumn("words", F.sum("source_size").over(every) * F.lit(float(budget))).withColumn("fill", F.col("cap") / F.col("w"))
    below = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.orderBy("fill", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(here))
    # The first source, in order of fill, that the level leaves below its cap: from it on, none stops.
    rows = rows.withColumn("line", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "place", "level"))).over(every))
    stops = F.col("line").isNull() | (F.struct("fill", "place") < F.struct(F.col("line.fill"), F.col("line.place")))
    return rows.select("source", "place", "source_size", F.when(stops, F.col("cap")).otherwise(F.col("line.level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), budget: float = 1.5, epochs: int = 2, seed: int = 17, schedules=SCHEDULES, digits: int = 3) -> DataFrame:
    """assign() as a table of words taken, range-sorted by position (the first epoch's; null where no word is taken)."""
    rows = assign(docs, id_col, text_col, source_col, weights, budget, epochs, seed, schedules, digits)
    rows = rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(F.col("positions")[0], 6).alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), budget: float = 1.5, epochs: int = 2, seed: int = 17, schedules=SCHEDULES, digits: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, content (hash of the text), size, source_size, target,
    taken, positions.

    size counts words in the text (null: 0). taken is how many of the document's words the mix reads, repeats counted: the
    part of [c, c + size) and of each later epoch's copy of it that lies below the source's target, where c is the document's
    cumulative size; so the words taken from a source add up to its rounded target, and none is read over epochs times. A
    null source is a source of its own, the last. positions: for each epoch the place in training time (0 to 1) of the
    first word that it takes; null where it takes none. Equal rows are interchangeable; reruns agree. An empty table gives an empty result. digits: hexadecimal
    digits of the digest that name a bucket (16 ** digits buckets for each source).
    """
    raw = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = raw.select("doc_id", "content", "source", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("size"), order.alias("digest"))
    sizes = materialise(sizes, "mix-sizes").withColumn("bucket", F.substring("digest", 1, digits))
    targets = source_targets(sizes, weights, budget, epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    t, b = targets.alias("t"), buckets.alias("b")
    starts = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("of"), F.col("b.bucket").alias("part"), "ahead", "place", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = placed.join(starts, placed["source"].eqNullSafe(starts["of"]) & (placed["bucket"] == starts["part"]))
    c, limit, size = F.col("ahead") + F.col("inner"), F.round("target").cast("long"), F.col("size")
    parts = [F.greatest(F.least(limit - F.col("source_size") * e - c, size), F.lit(0)) for e in range(epochs)]
    positions = []
    for e, part in enumerate(parts):
        share, time = F.try_divide((c + F.col("source_size") * e).cast("double"), F.col("target")), F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            time = F.when(F.pmod(F.col("place"), F.lit(len(schedules))) == k, invert_schedule(share, knots)).otherwise(time)
        positions.append(F.when(part > 0, time))
    return rows.select("doc_id", "content", "size", "source_size", "target", sum(parts, F.lit(0)).cast("long").alias("taken"), F.array(*positions).alias("positions"))


def read_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, all columns, once for each epoch in which the mix takes words of them, range-sorted by position. A
    document of which the mix takes no word goes, unless it has none. Rows that repeat both id and text are read alike."""
    rows = assign(docs, id_col, text_col, source_col, **options)
    empty = F.array(F.lit(1.0))
    rows = rows.select("doc_id", "content", F.when(F.col("size") == 0, empty).otherwise(F.filter("positions", lambda p: p.isNotNull())).alias("at")).where(F.size("at") > 0)
    plan = rows.groupBy("doc_id", "content").agg(F.max("at").alias("at"))
    key, position, who, content, at = fresh(docs, "key", "position", "who", "of", "at")
    plan = plan.toDF(who, content, at)
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    read = keyed.join(plan, F.col(id_col).eqNullSafe(F.col(who)) & (F.col(key) == F.col(content)))
    return read.select(*docs.columns, F.explode(at).alias(position)).orderBy(position, id_col).drop(position)


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('17:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS words FROM s),
f AS (SELECT *, cap / w AS fill FROM w),
l AS (SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
first_open AS (SELECT fill AS fill0, place AS place0, level AS level0 FROM l WHERE level <= fill ORDER BY fill, place LIMIT 1),
t AS (SELECT source, place, source_size,
             CASE WHEN fill0 IS NULL OR fill < fill0 OR (fill = fill0 AND place < place0) THEN cap ELSE level0 * w END AS target
      FROM l LEFT JOIN first_open ON TRUE),
c AS (SELECT d.doc_id, d.size, t.source_size, t.place, t.target, round(t.target)::BIGINT AS lim,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(greatest(lim - c, 0), size) + least(greatest(lim - source_size - c, 0), size) AS taken, c::DOUBLE / nullif(target, 0) AS share,
             CASE place % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
             CASE place % 3 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS m FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(2.0::DOUBLE * share / (w0 + sqrt(greatest(w0 * w0 + 2.0::DOUBLE * m * share, 0.0::DOUBLE))), 6) END AS position
FROM k
"""
