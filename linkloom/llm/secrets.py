"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Patterns find candidates (kind, first and end code point, value). The hashes of their values are counted over the whole
corpus by distinct owners and distinct repositories: a value that several owners or many repositories carry is a widely
copied example, one that stays with one owner looks like a live credential. Counting goes through (hash, owner, repository),
then (hash, owner), then hash, each with a map-side partial aggregate, so a value that a third of all rows carry costs each
map task one row. Texts are read once; what is joined afterwards is candidates only.

Positions come from splitting a text at the matches of a pattern: the pieces and the matches, in turn, are the text. Matches are
placed in blocks, so that a text of many matches costs in proportion to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise

# Fixed values of the contract. Letters of the assigned names stand in either case; written out, so that no engine folds others.
NAME = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
LEAD = NAME + """["']?\\x20*[:=]\\x20*["']?"""
ASSIGN = LEAD + "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of 20 or more; shorter runs fail as a whole
HEX = "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "live", "example")
QUICK = "(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|AKIA|[0-9a-f]{24})"


#: Matches that one fold places; a fold copies its list at every step.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """(start, end, kind, lead, value) of the pattern's leftmost matches that don't overlap; lead: characters before the value."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    gaps = F.transform(pieces, F.length)
    sizes = _let(gaps, lambda g: F.transform(found, lambda m, k: F.struct(F.get(g, k).alias("gap"), F.length(m).alias("n"), m.alias("m"))))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,lead:int,value:string>>)")

    def step(acc, x):
        a = acc["at"] + x["gap"]
        lead = F.length(x["m"]) - F.length(F.regexp_replace(x["m"], F.lit("^" + LEAD), F.lit(""))) if kind == 0 else F.lit(0)
        one = F.struct(a.alias("start"), (a + x["n"]).alias("end"), F.lit(kind).alias("kind"), lead.alias("lead"), F.substr(x["m"], lead + 1).alias("value"))
        return F.struct((a + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def cut(s):
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(s) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK)))

    def starts(blocks):
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
        return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + length(b))))

    def placed(blocks, at):
        inside = lambda b, k: F.aggregate(b, F.struct(F.get(at, k).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.transform(blocks, inside))

    out = _let(sizes, lambda s: _let(cut(s), lambda blocks: _let(starts(blocks), lambda at: placed(blocks, at))))
    return F.filter(out, lambda s: F.length(s["value"]) >= LEAST_ASSIGNED) if kind == 0 else out


def candidates(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """doc_id, content (hash of the text), repository, owner, spans (in order of start, then kind) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"), F.xxhash64(text).alias("content"))
    found = F.concat(*[_spans(F.col("text"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX))])
    by_place = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["lead"].alias("lead"), F.xxhash64(s["value"]).alias("hash"))))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,lead:int,hash:bigint>>)")
    return rows.select("doc_id", "content", "repository", "owner", F.when(F.col("text").rlike(QUICK), by_place).otherwise(none).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories of every candidate value. A null owner or repository counts as one of its own."""
    each = found.select(F.explode("spans").alias("s"), F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repository"), F.lit("")).alias("repository"))
    each = each.select(F.col("s.hash").alias("hash"), "owner", "repository").groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owned = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    # A repository belongs to its owner: the same name under another owner is another repository.
    return owned.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", owners: int = 2, repositories: int = 25) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Base spans are the matches of the three patterns; each candidate's value also gets a span of kind `example`, if at least
    `owners` owners or `repositories` repositories carry it, and of kind `live` if not. Positions are code points, ends
    exclusive. A null text counts as empty; repeated rows get the same answer and count as one repository; a null owner or
    repository counts as one of its own; an empty table gives an empty result."""
    found = materialise(candidates(docs, id_col, text_col, repository_col, owner_col), "secrets")
    counts = ownership(found).where((F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories)).select("hash")
    wide = materialise(counts, "secret-owners")
    having = found.where(F.size("spans") > 0).select("doc_id", "content", F.explode("spans").alias("s")).select("doc_id", "content", "s", F.col("s.hash").alias("value_hash"))
    told = having.join(wide, having["value_hash"] == wide["hash"], "left").select(F.col("doc_id").alias("id"), F.col("content").alias("of"), F.struct(F.col("s.start"), F.col("s.kind"), F.col("s.end")).alias("base"), F.struct((F.col("s.start") + F.col("s.lead")).alias("start"), F.when(F.col("hash").isNull(), 3).otherwise(4).alias("kind"), F.col("s.end").alias("end")).alias("own"))
    lists = told.groupBy("id", "of").agg(F.array_sort(F.concat(F.collect_set("base"), F.collect_set("own"))).alias("all"))
    kinds = F.transform("spans", lambda s: s["kind"])
    n = lambda arr, k: F.size(F.filter(arr, lambda x: x == k)).cast("long")
    marked = F.coalesce(F.transform("all", lambda s: s["kind"]), F.expr("cast(array() as array<int>)"))
    joined = found.join(lists, found["doc_id"].eqNullSafe(lists["id"]) & (found["content"] == lists["of"]), "left")
    return joined.select("doc_id", n(kinds, 0).alias("n_assign"), n(kinds, 1).alias("n_access"), n(kinds, 2).alias("n_hex"), F.sha2(_joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"), n(marked, 3).alias("n_live"), n(marked, 4).alias("n_example"))


def _sql(owners: int = 2, repositories: int = 25) -> str:
    def spans(kind: int, pattern: str) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, t, {kind} AS kind, m, k, pieces, found FROM
  (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS pieces FROM d), unnest(found) WITH ORDINALITY AS u(m, k)"""

    lead = LEAD.replace("'", "''")
    return f"""
WITH d AS (SELECT DISTINCT doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(spans(k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX)))}),
placed AS (SELECT doc_id, t, kind, m,
    (list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a FROM raw),
told AS (SELECT doc_id, t, kind, a, a + length(m) AS b, CASE WHEN kind = 0 THEN regexp_replace(m, '^{lead}', '') ELSE m END AS v FROM placed),
base AS (SELECT * FROM told WHERE kind > 0 OR length(v) >= {LEAST_ASSIGNED}),
wide AS (SELECT v FROM base JOIN d USING (doc_id, t) GROUP BY v HAVING count(DISTINCT coalesce('=' || source, '')) >= {owners} OR count(DISTINCT (coalesce('=' || source, ''), doc_id)) >= {repositories}),
own AS (SELECT DISTINCT doc_id, t, CASE WHEN wide.v IS NULL THEN 3 ELSE 4 END AS kind, b - length(base.v) AS a, b FROM base LEFT JOIN wide ON base.v = wide.v),
every AS (SELECT doc_id, t, kind, a, b FROM base UNION ALL SELECT doc_id, t, kind, a, b FROM own),
lists AS (SELECT doc_id, t, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3, count(*) FILTER (kind = 4) AS n4,
    coalesce(string_agg(['assign', 'access', 'hex', 'live', 'example'][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b) FILTER (kind < 3), '') AS base_text,
    string_agg(['assign', 'access', 'hex', 'live', 'example'][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS all_text
  FROM every GROUP BY doc_id, t)
SELECT x.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256,
       coalesce(all_text, '') AS spans, coalesce(n3, 0)::BIGINT AS n_live, coalesce(n4, 0)::BIGINT AS n_example
FROM documents x LEFT JOIN lists ON x.doc_id IS NOT DISTINCT FROM lists.doc_id AND coalesce(x.text, '') = lists.t
"""


SQL = _sql()
