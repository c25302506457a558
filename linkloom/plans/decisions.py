"""Relations for identifiers, sources and sinks, learned maps, mining, decision rules and metrics."""

from __future__ import annotations

from ..config import DEFAULT as C
from .dialect import Dialect
from .relations import PAIR, ascii, norm_addr, norm_name, relation

HASH = "(num * 2654435761) % 4294967296"
U = f"{HASH} / CAST(4294967296 AS DOUBLE)"


# ---- identifiers, sources and sinks ----


@relation()
def id_num(d: Dialect) -> str:
    return f"SELECT c_name, {d.long('substr(c_name, 10)')} AS num FROM customer"


@relation()
def pack_pair(d: Dialect) -> str:
    packed = "((s1_num * 8589934592) + b_num * 2 + CASE WHEN src = 3 THEN 1 ELSE 0 END)"
    if d.spark:
        packed = "(shiftleft(s1_num, 33) | shiftleft(b_num, 1) | CAST(src = 3 AS BIGINT))"
        back = "shiftright(packed, 33) AS s1_back, shiftright(packed, 1) & 4294967295 AS b_back, packed & 1 AS is_s3"
    else:
        back = "packed >> 33 AS s1_back, (packed >> 1) & 4294967295 AS b_back, packed & 1 AS is_s3"
    return f"SELECT country, s1_num, src, b_num, packed, {back} FROM (SELECT country, s1_num, src, b_num, {d.long(packed)} AS packed FROM @truth) x"


@relation()
def u01_split(d: Dialect) -> str:
    part = f"CASE WHEN u >= {C.hold_from * C.hold} AND u < {C.hold} THEN 'hold' WHEN u < {C.train_to} THEN 'train' ELSE 'rest' END"
    return f"SELECT num, round(u, 9) AS u, {part} AS part FROM (SELECT num, {U} AS u FROM @records WHERE src = 1) x"


@relation()
def cv_fold(d: Dialect) -> str:
    return f"SELECT num, {d.long(f'({HASH}) % 5')} AS fold, ({HASH}) % 100 = 0 AS validation FROM @records WHERE src = 1"


@relation()
def scan_records(d: Dialect) -> str:
    return "SELECT num, country, src, name, address FROM @raw"


@relation()
def source_rows(d: Dialect) -> str:
    """Records as a source's columns."""
    return "SELECT concat('S', CAST(src AS VARCHAR(4)), '-', CAST(num AS VARCHAR(20))) AS entity_id, nullif(name, '') AS business_name, nullif(address, '') AS business_address, country FROM @raw"


@relation()
def country_subset(d: Dialect) -> str:
    return f"SELECT num, src, name_n FROM @records WHERE {d.one_of('country', C.countries)}"


@relation()
def truth_lists(d: Dialect) -> str:
    """Each record of source 1 with its true partners as one delimited text, empty for singletons."""
    items = "concat('S', CAST(t.src AS VARCHAR(4)), '-', CAST(t.b_num AS VARCHAR(20)))"
    agg = f"array_join(array_sort(collect_list({items})), ',')" if d.spark else f"coalesce(string_agg({items}, ',' ORDER BY {items}), '')"
    return f"SELECT s1_num, CASE WHEN n = 0 THEN '' ELSE ids END AS matched FROM (SELECT r.num AS s1_num, count(t.b_num) AS n, {agg} AS ids FROM @records r LEFT JOIN @truth t ON t.s1_num = r.num AND t.country = r.country WHERE r.src = 1 GROUP BY r.num) x"


@relation()
def truth_explode(d: Dialect) -> str:
    parts = "split(matched, ',')" if d.spark else "string_split(matched, ',')"
    return f"SELECT s1_num, {d.long('substr(id, 2, 1)')} AS src, {d.long('substr(id, 4)')} AS b_num FROM @truth_lists, {d.rows(parts, 'e', 'id')} WHERE matched <> ''"


def _id_lists(d: Dialect, pairs: str) -> str:
    if d.spark:
        agg = "array_join(transform(array_sort(collect_list(struct(src, b_num))), x -> concat('S', cast(x.src AS string), '-', cast(x.b_num AS string))), ',')"
    else:
        agg = "string_agg('S' || src || '-' || b_num, ',' ORDER BY src, b_num)"
    return f"SELECT country, s1_num, {agg} AS ids FROM {pairs} GROUP BY country, s1_num"


def _table(d: Dialect, pairs: str) -> str:
    return f"SELECT concat('S1-', CAST(r.num AS VARCHAR(20))) AS source1_entity_id, coalesce(l.ids, '') AS matched_entity_ids FROM @records r LEFT JOIN ({_id_lists(d, pairs)}) l ON l.country = r.country AND l.s1_num = r.num WHERE r.src = 1"


@relation()
def join_ids(d: Dialect) -> str:
    return _id_lists(d, "@truth")


@relation()
def candidate_table(d: Dialect) -> str:
    return _table(d, "@scored")


@relation()
def result_table(d: Dialect) -> str:
    return _table(d, "@decide_threshold")


# ---- normalisation on its own ----


@relation()
def fold_accents(d: Dialect) -> str:
    return f"SELECT num, {d.fold('name')} AS folded FROM @raw"


@relation()
def norm_names(d: Dialect) -> str:
    return f"SELECT num, {norm_name(d, 'name')} AS name_n FROM @raw"


@relation()
def norm_addrs(d: Dialect) -> str:
    return f"SELECT num, {norm_addr(d, 'address')} AS addr_n FROM @raw"


@relation()
def normalize_records(d: Dialect) -> str:
    return "SELECT country, src, num, name_n, addr_n, name_nonlatin FROM @records"


@relation()
def token_map(d: Dialect) -> str:
    """A map of tokens: learned variants, overridden by fixed ones."""
    return """SELECT country, tok, repl FROM (SELECT country, tok, repl, row_number() OVER (PARTITION BY country, tok ORDER BY pri DESC, repl) AS rk FROM
 (SELECT country, tok, repl, 1 AS pri FROM @learn_alias UNION ALL SELECT country, tok, repl, 2 AS pri FROM @fixed_tokens) x) y WHERE rk = 1"""


@relation()
def fixed_tokens(d: Dialect) -> str:
    """country, tok, repl: replacements that override learned ones. A caller gives this relation; by itself it has none."""
    return "SELECT country, name_n AS tok, name_n AS repl FROM @records WHERE 1 = 0"


@relation()
def apply_token_map(d: Dialect) -> str:
    """Names with mapped tokens, in their order."""
    agg = "array_join(transform(array_sort(collect_list(struct(k, t))), x -> x.t), ' ')" if d.spark else "string_agg(t, ' ' ORDER BY k)"
    return f"""SELECT r.country, r.src, r.num, coalesce(m.mapped, '') AS name_m FROM @records r LEFT JOIN
 (SELECT country, src, num, {agg} AS mapped FROM (SELECT x.country, x.src, x.num, x.k, coalesce(m.repl, x.tok) AS t FROM @name_places x LEFT JOIN @token_map m ON m.country = x.country AND m.tok = x.tok) y GROUP BY country, src, num) m
 ON m.country = r.country AND m.src = r.src AND m.num = r.num"""


@relation()
def untranslated_tokens(d: Dialect) -> str:
    return f"SELECT DISTINCT country, tok FROM @tokens WHERE field = 'name' AND NOT {ascii(d, 'tok')}"


# ---- learned maps ----


def places_of(d: Dialect, column: str) -> str:
    """Tokens of a column of records with their places."""
    w = d.words(f"r.{column}")
    if d.spark:
        return f"SELECT country, src, num, CAST(pos + 1 AS BIGINT) AS k, tok FROM (SELECT r.country, r.src, r.num, posexplode({w}) AS (pos, tok) FROM @records r) x"
    return f"SELECT country, src, num, CAST(k AS BIGINT) AS k, w[k] AS tok FROM (SELECT country, src, num, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT r.country, r.src, r.num, {w} AS w FROM @records r) z) x"


@relation()
def name_places(d: Dialect) -> str:
    """Tokens of names with their places."""
    return places_of(d, "name_n")


def lexicon_pairs_of(d: Dialect, truth: str, places: str) -> str:
    """Tokens beyond ASCII of a partner's text with the tokens of the record's, weighed by how near their places are."""
    return f"""SELECT t.country, t.s1_num, t.src, t.b_num, b.tok AS tok, a.tok AS repl, 1.0 / (1 + abs(b.k - a.k)) AS w FROM {truth} t
JOIN {places} a ON a.src = 1 AND a.country = t.country AND a.num = t.s1_num JOIN {places} b ON b.src = t.src AND b.country = t.country AND b.num = t.b_num WHERE NOT {ascii(d, 'b.tok')}"""


@relation()
def lexicon_pairs(d: Dialect) -> str:
    return lexicon_pairs_of(d, "@truth", "@name_places")


def lexicon_of(pairs: str, by: str = "") -> str:
    """The replacement of each token (within a column `by`) that stands nearest it most often, against the pairs that have either."""
    pair = "concat(country, '-', CAST(s1_num AS VARCHAR(20)), '-', CAST(src AS VARCHAR(4)), '-', CAST(b_num AS VARCHAR(20)))"
    c, w = (f"{by}, ", f"w.{by}, ") if by else ("", "")
    on = (lambda t: f" AND {t}.{by} = w.{by}") if by else (lambda t: "")
    return f"""SELECT {c}tok, repl, round(score, 6) AS score FROM (SELECT {w}w.tok, w.repl, w.w / (n.c + l.c - w.w) AS score, row_number() OVER (PARTITION BY {w}w.tok ORDER BY round(w.w / (n.c + l.c - w.w), 8) DESC, w.repl) AS rk FROM
 (SELECT {c}tok, repl, CAST(sum(w) AS DOUBLE) AS w FROM {pairs} GROUP BY {c}tok, repl) w
 JOIN (SELECT {c}tok, count(DISTINCT {pair}) AS c FROM {pairs} GROUP BY {c}tok) n ON n.tok = w.tok{on('n')}
 JOIN (SELECT {c}repl, count(DISTINCT {pair}) AS c FROM {pairs} GROUP BY {c}repl) l ON l.repl = w.repl{on('l')}) x WHERE rk = 1 AND score >= 0"""


@relation()
def learn_lexicon(d: Dialect) -> str:
    """Replacements of name tokens beyond ASCII, from all true pairs."""
    return lexicon_of("@lexicon_pairs")


def missing_of(d: Dialect, column: str) -> str:
    """Tokens that one record of a true pair has and the other lacks, both ways, where both have any."""
    x, y = d.words(f"a.{column}"), d.words(f"b.{column}")
    a = d.filter("(" + d.minus(y, x) + ")", "t", d.matches("t", "^[a-z]{3,}$"))
    b = d.filter("(" + d.minus(x, y) + ")", "t", d.matches("t", "^[\\p{L}]{3,}$"))
    return f"""SELECT t.country, t.s1_num, t.src, t.b_num, {a} AS extra, {b} AS gone FROM @learning_truth t JOIN @records a ON a.src = 1 AND a.country = t.country AND a.num = t.s1_num
JOIN @records b ON b.src = t.src AND b.country = t.country AND b.num = t.b_num WHERE a.{column} <> '' AND b.{column} <> ''"""


@relation()
def missing_tokens(d: Dialect) -> str:
    return missing_of(d, "addr_n")


def alias_counts_of(d: Dialect, missing: str) -> str:
    """Each extra token, in how many pairs it is extra, and the token most often gone with it."""
    lists = "(SELECT country, extra, gone FROM {} WHERE {} > 0 AND {} > 0) p".format(missing, d.size("extra"), d.size("gone"))
    return f"""SELECT n.country, n.tok, n.n, c.repl, c.c FROM (SELECT country, tok, count(*) AS n FROM {lists}, {d.rows('extra', 'e', 'tok')} GROUP BY country, tok) n
JOIN (SELECT country, tok, repl, c, row_number() OVER (PARTITION BY country, tok ORDER BY c DESC, repl) AS rk FROM (SELECT country, tok, repl, count(*) AS c FROM {lists}, {d.rows('extra', 'e', 'tok')}, {d.rows('gone', 'g', 'repl')} GROUP BY country, tok, repl) x) c
ON c.country = n.country AND c.tok = n.tok AND c.rk = 1"""


@relation()
def alias_counts(d: Dialect) -> str:
    return alias_counts_of(d, "@missing_tokens")


@relation()
def learn_alias_basic(d: Dialect) -> str:
    """Aliases by precision alone, without chains: a replacement is not itself replaced."""
    good = f"(SELECT country, tok, repl, n, c FROM @alias_counts WHERE n >= {C.alias_count} AND tok <> repl AND c / CAST(n AS DOUBLE) >= {C.alias_precision})"
    return f"SELECT a.country, a.tok, a.repl, a.n, a.c FROM {good} a LEFT JOIN {good} b ON b.country = a.country AND b.tok = a.repl WHERE b.tok IS NULL"


@relation()
def learn_alias(d: Dialect) -> str:
    """Aliases that are spelling variants, or strong synonyms rare in reference addresses and not among its commonest tokens."""
    good = f"""(SELECT a.country, a.tok, a.repl, a.n, a.c FROM @alias_counts a LEFT JOIN @reference_df x ON x.country = a.country AND x.tok = a.tok LEFT JOIN @reference_df y ON y.country = a.country AND y.tok = a.repl
 WHERE a.n >= {C.alias_count} AND a.tok <> a.repl AND a.c / CAST(a.n AS DOUBLE) >= {C.alias_precision}
 AND ({d.indel('a.tok', 'a.repl')} >= {C.alias_typo} OR (a.c / CAST(a.n AS DOUBLE) >= {C.alias_synonym} AND coalesce(y.rk, 101) > 100 AND coalesce(x.df, 0) < {C.alias_rarity} * coalesce(y.df, 0))))"""
    return f"SELECT a.country, a.tok, a.repl, a.n, a.c FROM {good} a LEFT JOIN {good} b ON b.country = a.country AND b.tok = a.repl WHERE b.tok IS NULL"


@relation()
def reference_df(d: Dialect) -> str:
    return "SELECT country, tok, df, row_number() OVER (PARTITION BY country ORDER BY df DESC, tok) AS rk FROM (SELECT country, tok, count(*) AS df FROM @tokens WHERE src = 1 AND field = 'addr' GROUP BY country, tok) x"


# ---- splits, mining, sets ----


@relation()
def label_pairs(d: Dialect) -> str:
    return f"SELECT {PAIR}, y FROM @pairs"


@relation()
def attach_records(d: Dialect) -> str:
    return f"SELECT {PAIR}, na, nb, aa, ab FROM @pairs"


@relation()
def pair_text(d: Dialect) -> str:
    return f"SELECT {PAIR}, concat(na, ' | ', coalesce(nullif(aa, ''), '-')) AS ta, concat(nb, ' | ', coalesce(nullif(ab, ''), '-')) AS tb FROM @pairs"


@relation()
def pair_text_export(d: Dialect) -> str:
    return f"SELECT t.country, t.s1_num, t.src, t.b_num, t.ta, t.tb, p.y, (t.s1_num * 2654435761) % 4294967296 % 100 = 0 AS validation FROM @pair_text t JOIN @pairs p ON p.country = t.country AND p.s1_num = t.s1_num AND p.src = t.src AND p.b_num = t.b_num"


@relation()
def hold_train_rows(d: Dialect) -> str:
    """Candidates whose partner is a candidate of any hold-out record are hold rows; others train if their record does."""
    return f"""SELECT p.country, p.s1_num, p.src, p.b_num, CASE WHEN h.b_num IS NOT NULL THEN 'hold' ELSE 'train' END AS part FROM @predicted p
LEFT JOIN (SELECT DISTINCT country, src, b_num FROM @predicted WHERE u >= {C.hold_from * C.hold} AND u < {C.hold}) h ON h.country = p.country AND h.src = p.src AND h.b_num = p.b_num
WHERE h.b_num IS NOT NULL OR p.u < {C.train_to}"""


@relation()
def uncertain_band(d: Dialect) -> str:
    return f"SELECT {PAIR}, p FROM @predicted WHERE p BETWEEN {C.low} AND {C.high}"


@relation()
def hard_negatives(d: Dialect) -> str:
    return f"SELECT {PAIR}, p FROM @alike WHERE NOT y AND near_alike"


@relation()
def alike(d: Dialect) -> str:
    """Scored candidates, and whether their names' or addresses' token sets are similar."""
    return """SELECT p.country, p.s1_num, p.src, p.b_num, p.p, p.y, s.n_tset >= 0.7 OR (p.a_missing < 0.5 AND coalesce(s.a_tset, 0) >= 0.7) AS near_alike FROM @predicted p
JOIN @pair_strings s ON s.country = p.country AND s.s1_num = p.s1_num AND s.src = p.src AND s.b_num = p.b_num"""


MINED = """SELECT country, s1_num, src, b_num, p, y, g, pri FROM (SELECT *, 'hard_pos' AS g, 1 AS pri FROM @alike WHERE y AND p < 0.9 UNION ALL SELECT *, 'pos' AS g, 2 AS pri FROM @alike WHERE y AND p >= 0.9
 UNION ALL SELECT *, 'hard_neg' AS g, 3 AS pri FROM @alike WHERE NOT y AND p >= 0.02 UNION ALL SELECT *, 'similar_neg' AS g, 4 AS pri FROM @alike WHERE NOT y AND p < 0.02 AND near_alike
 UNION ALL SELECT *, 'rand_neg' AS g, 5 AS pri FROM @alike WHERE NOT y AND p < 0.02) m"""
ORDER = "(s1_num * 2654435761 + b_num * 40503 + src) % 4294967296"


def ranked(rows: str, by: str, order: str) -> str:
    """rows (with a column part, whose order is the first of the order) with their rank within by, and the size of their group:
    counts of the parts, a running sum over those, and ranks within a part."""
    return f"""SELECT z.*, z.inner_rk + s.ahead AS rk, s.total FROM (SELECT *, {by} AS grp, row_number() OVER (PARTITION BY {by}, part ORDER BY {order}) AS inner_rk FROM {rows}) z
JOIN (SELECT grp, part, sum(n) OVER (PARTITION BY grp ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS ahead, sum(n) OVER (PARTITION BY grp) AS total
  FROM (SELECT {by} AS grp, part, count(*) AS n FROM {rows} GROUP BY {by}, part) c) s ON s.grp = z.grp AND s.part = z.part"""


def lowest(rows: str, by: str, most: str, order: str) -> str:
    """The rows of each group with the lowest o (ties by order), at most `most` (which may read total, the group's size)."""
    parted = f"(SELECT *, CAST(floor(o / 1048576.0) AS BIGINT) AS part FROM {rows}) r"
    return f"SELECT * FROM ({ranked(parted, by, f'o, {order}')}) v WHERE rk <= {most}"


@relation()
def mine_groups(d: Dialect) -> str:
    return f"SELECT {PAIR}, g FROM ({MINED}) x"


@relation()
def quota_sample(d: Dialect) -> str:
    """At most 20 pairs of each group, those with the lowest hash."""
    return f"SELECT {PAIR}, g FROM ({lowest(f'(SELECT *, {ORDER} AS o FROM ({MINED}) q) x', 'g', '20', 'country, s1_num, src, b_num')}) y"


@relation()
def proportional_quota(d: Dialect) -> str:
    """A tenth of each country's pairs, rounded up, those with the lowest hash."""
    return f"SELECT {PAIR} FROM ({lowest(f'(SELECT {PAIR}, {ORDER} AS o FROM @predicted) x', 'country', 'ceil(total / 10.0)', 's1_num, src, b_num')}) y"


@relation()
def dedupe_priority(d: Dialect) -> str:
    return f"SELECT {PAIR}, g FROM (SELECT *, row_number() OVER (PARTITION BY country, s1_num, src, b_num ORDER BY pri) AS rk FROM ({MINED}) x) y WHERE rk = 1"


@relation()
def v3_selection(d: Dialect) -> str:
    """Uncertain or wrong pairs; clear mistakes twice; and of the rest, the easy ones, so many as the configuration keeps, those
    with the lowest hash (found through counts by hash range, so that no task ranks them all)."""
    e = "abs(p - CASE WHEN y THEN 1 ELSE 0 END)"
    hard = f"{e} > 0.2 OR (p > 0.05 AND p < 0.95)"
    easy = f"(SELECT {PAIR}, p, {ORDER} AS o FROM @predicted WHERE NOT ({hard})) x"
    return f"""SELECT {PAIR}, p FROM @predicted WHERE {hard} UNION ALL SELECT {PAIR}, p FROM @predicted WHERE {e} > 0.5
UNION ALL SELECT {PAIR}, p FROM ({lowest(easy, "1", f"{C.keep_easy}", "country, s1_num, src, b_num")}) w"""


@relation()
def every_kth_row(d: Dialect) -> str:
    # The range of a row is its record's: records stand in their order, so ranges do as well.
    return f"SELECT {PAIR} FROM ({ranked('(SELECT ' + PAIR + ', CAST(floor(s1_num / 64.0) AS BIGINT) AS part FROM @predicted) x', 'country', 's1_num, src, b_num')}) y WHERE rk % 8 = 1"


@relation()
def pseudo_labels(d: Dialect) -> str:
    return f"SELECT {PAIR}, p >= 0.97 AS y FROM @predicted WHERE p >= 0.97 OR p <= 0.03"


@relation()
def left_join_scores(d: Dialect) -> str:
    """Candidates with the score of the uncertain ones, null for others."""
    return "SELECT c.country, c.s1_num, c.src, c.b_num, u.p AS nn FROM @scored c LEFT JOIN @uncertain_band u ON u.country = c.country AND u.s1_num = c.s1_num AND u.src = c.src AND u.b_num = c.b_num"


@relation()
def neural_columns(d: Dialect) -> str:
    """Score and its logit, both absent where the pair was not scored."""
    c = "CASE WHEN nn IS NOT NULL THEN greatest(least(nn, 1 - 1e-6), 1e-6) END"
    return f"SELECT {PAIR}, nn AS nn_p, round(ln({c} / (1 - {c})), 6) AS nn_logit, CASE WHEN nn IS NULL THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS nn_missing FROM @left_join_scores"


@relation()
def pair_union(d: Dialect) -> str:
    return "SELECT country, s1_num, src, b_num FROM @block_forward UNION SELECT country, s1_num, src, b_num FROM @block_reverse"


@relation()
def pair_except(d: Dialect) -> str:
    return "SELECT country, s1_num, src, b_num FROM @block_reverse EXCEPT SELECT country, s1_num, src, b_num FROM @block_forward"


@relation()
def pair_intersect(d: Dialect) -> str:
    return "SELECT country, s1_num, src, b_num FROM @block_reverse INTERSECT SELECT country, s1_num, src, b_num FROM @block_forward"


# ---- windows and ranks on their own ----


@relation()
def rank_first(d: Dialect) -> str:
    return "SELECT country, s1_num, src, b_num, CAST(rank_s1 AS BIGINT) AS rank_s1, CAST(rank_b AS BIGINT) AS rank_b FROM @competition"


@relation()
def running_sum(d: Dialect) -> str:
    return f"SELECT {PAIR}, round(sum(p) OVER (PARTITION BY country, s1_num ORDER BY p DESC, src, b_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS s FROM @predicted"


@relation()
def group_head_n(d: Dialect) -> str:
    return f"SELECT {PAIR} FROM (SELECT *, row_number() OVER (PARTITION BY country, s1_num ORDER BY p DESC, src, b_num) AS rk FROM @predicted) x WHERE rk <= 3"


@relation()
def topk_rerank(d: Dialect) -> str:
    return "SELECT country, s1_num, src, b_num FROM @block_jaccard"


@relation()
def quantile_grid(d: Dialect) -> str:
    """201 quantiles of the score by country, linearly interpolated, without repeats."""
    qs = ", ".join(f"{k / 200}" for k in range(201))
    q = f"explode(array_distinct(transform(percentile(p, array({qs.replace(', ', 'D, ')}D)), x -> round(x, 9))))" if d.spark else f"unnest(list_distinct(list_transform(quantile_cont(p, [{qs}]), lambda x: round(x, 9))))"
    return f"SELECT country, {q} AS q FROM @predicted GROUP BY country"


@relation()
def percentile_lookup(d: Dialect) -> str:
    """Share of its country's grid that a score reaches: the grid is one list for each country."""
    grid = "collect_list(q)" if d.spark else "list(q)"
    return f"SELECT p.country, p.s1_num, p.src, p.b_num, round(CAST({d.size(d.filter('g.qs', 'q', 'q <= p.p'))} AS DOUBLE) / {d.size('g.qs')}, 6) AS pct FROM @predicted p JOIN (SELECT country, {grid} AS qs FROM @quantile_grid GROUP BY country) g ON g.country = p.country"


# ---- decisions and metrics ----


@relation()
def one_owner(d: Dialect) -> str:
    """Each partner goes to its best record, among scores from the floor on."""
    return f"SELECT {PAIR}, p, y, u FROM (SELECT *, row_number() OVER (PARTITION BY country, src, b_num ORDER BY p DESC, s1_num) AS rk FROM @predicted WHERE p >= {C.floor}) x WHERE rk = 1"


@relation()
def decide_threshold(d: Dialect) -> str:
    return f"SELECT {PAIR}, p FROM @one_owner WHERE p >= {C.threshold}"


def expected_f(prior: float = 0.0) -> str:
    w = "PARTITION BY country, s1_num"
    return f"""SELECT country, s1_num, src, b_num, p FROM (SELECT *, min(CASE WHEN f >= best - 1e-12 THEN k END) OVER ({w}) AS stop FROM (SELECT *, max(f) OVER ({w}) AS best FROM
 (SELECT country, s1_num, src, b_num, p, k, none, 1.25 * s / (k + 0.25 * (total + {prior})) AS f FROM (SELECT country, s1_num, src, b_num, p, row_number() OVER ({w} ORDER BY p DESC, src, b_num) AS k, sum(p) OVER ({w} ORDER BY p DESC, src, b_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
  sum(p) OVER ({w}) AS total, exp(sum(ln(1 - least(p, 1 - 1e-9))) OVER ({w})) AS none FROM @one_owner) a) b) c) e WHERE k <= stop AND none <= best"""


@relation()
def decide_expected_f(d: Dialect) -> str:
    return expected_f()


F_HALF = "CASE WHEN n_true = 0 THEN CASE WHEN n_sel = 0 THEN 1.0 ELSE 0.0 END WHEN n_sel = 0 OR n_hit = 0 THEN 0.0 ELSE 1.25 * (n_hit / n_sel) * (n_hit / n_true) / (0.25 * (n_hit / n_sel) + n_hit / n_true + 1e-12) END"


def _scores(pairs: str, by: str = "", grid: str = "") -> str:
    """F of every record of source 1 under selected pairs; grid: a table of settings, by: its column."""
    g = f"g.{by}, " if by else ""
    return f"""SELECT {by + ', ' if by else ''}country, num, CAST({F_HALF} AS DOUBLE) AS f FROM (SELECT {g}r.country, r.num, CAST(coalesce(t.n, 0) AS DOUBLE) AS n_true, CAST(coalesce(s.n, 0) AS DOUBLE) AS n_sel, CAST(coalesce(s.hit, 0) AS DOUBLE) AS n_hit
 FROM @records r {'CROSS JOIN ' + grid + ' g' if by else ''} LEFT JOIN (SELECT country, s1_num, count(*) AS n FROM @truth GROUP BY country, s1_num) t ON t.country = r.country AND t.s1_num = r.num
 LEFT JOIN (SELECT {by + ', ' if by else ''}country, s1_num, count(*) AS n, sum(CASE WHEN y THEN 1 ELSE 0 END) AS hit FROM {pairs} GROUP BY {by + ', ' if by else ''}country, s1_num) s ON s.country = r.country AND s.s1_num = r.num {f'AND s.{by} = g.{by}' if by else ''} WHERE r.src = 1) x"""


@relation()
def entity_f05(d: Dialect) -> str:
    return _scores(f"(SELECT * FROM @one_owner WHERE p >= {C.threshold})")


@relation()
def macro_f05(d: Dialect) -> str:
    return "SELECT country, count(*) AS n, round(avg(f), 6) AS f05 FROM @entity_f05 GROUP BY country"


@relation()
def metric_by_country_rollup(d: Dialect) -> str:
    return "SELECT coalesce(country, 'all') AS country, count(*) AS n, round(avg(f), 6) AS f05 FROM @entity_f05 GROUP BY ROLLUP(country)"


GRID = "(" + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS t" for k in range(30, 100, 5)) + ")"


@relation()
def threshold_sweep(d: Dialect) -> str:
    """Mean F at each threshold; the best is the lowest of those that share the maximum."""
    pairs = f"(SELECT w.t, o.* FROM @one_owner o JOIN {GRID} w ON o.p >= w.t / 100.0)"
    return f"SELECT t, round(f, 6) AS f05, row_number() OVER (ORDER BY round(f, 9) DESC, t) = 1 AS best FROM (SELECT t, avg(f) AS f FROM ({_scores(pairs, 't', GRID)}) y GROUP BY t) z"


@relation()
def threshold_sweep_2(d: Dialect) -> str:
    """The sweep with and without the owner rule."""
    grid = f"(SELECT concat(rule, '-', CAST(t AS VARCHAR(4))) AS setting, rule, t FROM (SELECT 'owner' AS rule UNION ALL SELECT 'plain' AS rule) r CROSS JOIN {GRID} q)"
    pairs = f"(SELECT w.setting, o.* FROM (SELECT 'owner' AS rule, country, s1_num, src, b_num, p, y FROM @one_owner UNION ALL SELECT 'plain' AS rule, country, s1_num, src, b_num, p, y FROM @predicted WHERE p >= {C.floor}) o JOIN {grid} w ON w.rule = o.rule AND o.p >= w.t / 100.0)"
    return f"SELECT setting, round(avg(f), 6) AS f05 FROM ({_scores(pairs, 'setting', grid)}) y GROUP BY setting"


@relation()
def prior_sweep(d: Dialect) -> str:
    """Pairs that expected F keeps under each prior."""
    return " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS prior, count(*) AS n_kept, round(sum(p), 6) AS sum_p FROM ({expected_f(p)}) x{k}" for k, p in enumerate((0.0, 0.1, 0.2, 0.3)))


@relation()
def ap_auc_logloss(d: Dialect) -> str:
    """Average precision (equal scores share one precision), area under the ROC curve (ties count half) and log loss."""
    # One row for each score (of six places, so a million at most); windows run over those.
    return """SELECT round(sum(k * tp / CAST(n AS DOUBLE)) / nullif(sum(k), 0), 6) AS ap,
 round((sum(k * (total - n + (m + 1) / 2.0)) - max(pos) * (max(pos) + 1) / 2.0) / nullif(max(pos) * (max(total) - max(pos)), 0), 6) AS auc,
 round(-sum(k * ln(greatest(p, 1e-9)) + (m - k) * ln(greatest(1 - p, 1e-9))) / max(total), 6) AS logloss FROM
 (SELECT p, k, m, CAST(sum(k) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS tp, CAST(sum(m) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS n,
  CAST(sum(k) OVER () AS DOUBLE) AS pos, CAST(sum(m) OVER () AS DOUBLE) AS total FROM (SELECT p, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS m FROM @predicted GROUP BY p) g) x"""


@relation()
def pivot_recall(d: Dialect) -> str:
    """Recall of the truth by country, a column for each way of blocking."""
    ways = ("forward", "reverse", "union")
    parts = " ".join(f"LEFT JOIN @block_{w} {w} ON {w}.country = t.country AND {w}.s1_num = t.s1_num AND {w}.src = t.src AND {w}.b_num = t.b_num" for w in ways).replace("union", "uni").replace("@block_uni", "@block_union")
    cols = ", ".join(f"round(avg(CAST(CASE WHEN {w}.b_num IS NULL THEN 0 ELSE 1 END AS DOUBLE)), 6) AS r_{w}" for w in ("forward", "reverse", "uni"))
    return f"SELECT t.country, {cols} FROM @truth t {parts} GROUP BY t.country"


@relation()
def crowded_parts(d: Dialect) -> str:
    """How many parts share a normalised name."""
    return f"SELECT name_n, count(*) AS n FROM (SELECT {norm_name(d, 'p_name')} AS name_n FROM part) x GROUP BY name_n"


QUERIES = tuple(
    """scan_records country_subset truth_explode result_table join_ids candidate_table pair_text_export id_num pack_pair u01_split cv_fold fold_accents norm_names norm_addrs
    apply_token_map normalize_records token_map untranslated_tokens learn_lexicon learn_alias learn_alias_basic hold_train_rows uncertain_band hard_negatives v3_selection every_kth_row
    label_pairs attach_records left_join_scores neural_columns pair_dot_product pair_text token_df core_tokens name_keys addr_keys block_forward block_addr_list
    block_reverse block_union candidates block_recall typo_keys block_channels split_numbers block_siblings block_address_first pair_features_tokens pair_features_strings pair_features_windows pair_features_edit
    jaro_winkler_names competition_features context_features anchor_features anchor_names anchor_tokens metric_by_country_rollup quantile_grid ap_auc_logloss rank_first running_sum percentile_lookup
    group_head_n topk_rerank pair_union pair_except pair_intersect dedupe_priority quota_sample proportional_quota mine_groups pseudo_labels one_owner decide_threshold decide_expected_f
    macro_f05 threshold_sweep threshold_sweep_2 prior_sweep pivot_recall crowded_parts token_idf_table block_index_table block_mass_table block_scores_table""".split()
)


@relation()
def token_idf_table(d: Dialect) -> str:
    return "SELECT country, field, tok, df, round(idf, 6) AS idf FROM @token_idf"


@relation()
def block_index_table(d: Dialect) -> str:
    return "SELECT country, src, fam, key, df, round(idf, 6) AS idf FROM @block_index"


@relation()
def block_mass_table(d: Dialect) -> str:
    return "SELECT country, src, num, index_src, round(m, 6) AS m, round(ma, 6) AS ma FROM @block_mass"


@relation()
def block_scores_table(d: Dialect) -> str:
    return "SELECT country, src, num, index_src, other, round(sn, 6) AS sn, round(sa, 6) AS sa FROM @block_scores"
