"""The linkage plan as named relations.

Each relation is one SELECT over others (written @name), rendered for Spark or for the oracle by a Dialect. A Workspace builds
the Spark side: a relation becomes a view, and those in STORED are written once, as Parquet, because several others read them.
The oracle side is the same relations as a WITH chain.
"""

from __future__ import annotations

from collections.abc import Callable

from ..config import DEFAULT as C
from . import words as W
from .dialect import Dialect

RELATIONS: dict[str, Callable[[Dialect], str]] = {}
STORED: set[str] = set()
#: Relations without an oracle: they use functions that the oracle's engine lacks.
SPARK_ONLY: set[str] = set()


def relation(stored: bool = False, spark_only: bool = False):
    def add(f):
        RELATIONS[f.__name__] = f
        if stored:
            STORED.add(f.__name__)
        if spark_only:
            SPARK_ONLY.add(f.__name__)
        return f

    return add


# ---- sources: the documents table as three sources of records ----


@relation()
def raw(d: Dialect) -> str:
    return f"""SELECT num, country, src, {d.join(d.slice('w', 1, 6))} AS name,
  CASE WHEN num % 7 = 0 THEN '' ELSE concat(CAST(n_chars % 1000 AS VARCHAR(20)), ' ', {d.join(d.slice('w', 7, 8))}) END AS address,
  lower({d.join(d.slice('w', 1, 12))}) AS head
FROM (SELECT {d.long('doc_id')} AS num, lang AS country, {d.long(d.extract('source', '[0-9]+'))} % 3 + 1 AS src, n_chars, {d.words('text')} AS w FROM documents) x"""


@relation()
def truth(d: Dialect) -> str:
    return """SELECT a.country, a.num AS s1_num, b.src, b.num AS b_num FROM @raw a JOIN @raw b ON a.country = b.country AND a.head = b.head
WHERE a.src = 1 AND b.src IN (2, 3)"""


# ---- normalisation ----


def _punctuated(d: Dialect, x: str) -> str:
    return d.replace(d.remove(d.remove(x, W.APOSTROPHES), "."), W.PUNCTUATION, " ")


def norm_name(d: Dialect, x: str) -> str:
    """Normalised name of a text."""
    end = "([^\\p{L}\\p{N}_]|$)"
    s = d.fold(x)
    for _ in range(2):  # a suffix right behind another shares its dot
        s = d.replace(s, f"\\.(?:{'|'.join(W.DOMAINS)}){end}", " \\1")
    s = _punctuated(d, f"replace({s}, '&', ' and ')")
    s = d.replace(f"concat(' ', {d.join(d.words(s), '  ')}, ' ')", " id  +\\p{Nd}+ ", " ")
    mixed = f"{d.matches('t', '[\\p{L}]')} AND {d.matches('t', '[\\p{Nd}]')}"
    folded = d.each(d.words(s), "t", f"CASE WHEN {mixed} THEN translate(t, '015', 'ols') ELSE t END")
    s = d.join(d.each(folded, "t", d.lookup("t", W.NAME_WORDS)))
    s = d.replace(s, "^m s (.)", "\\1")
    return d.replace(s, f"^(?:(?:{'|'.join(W.HONORIFICS)}) )+(.)", "\\1")


def norm_addr(d: Dialect, x: str) -> str:
    """Normalised address of a text."""
    s = f"concat('  ', {d.join(d.words(_punctuated(d, d.fold(x))), '  ')}, '  ')"
    for state in sorted(W.STATES, key=lambda k: (-len(k), k)):
        s = f"replace({s}, ' {state.replace(' ', '  ')} ', ' {W.STATES[state]} ')"
    t = d.filter(d.words(s), "t", f"NOT {d.one_of('t', W.NULL_WORDS)}")
    t = d.each(t, "t", d.lookup("t", W.ORDINALS))
    t = d.each(t, "t", d.replace("t", "^(\\p{Nd}+)(?:st|nd|rd|th|er|e|eme)$", "\\1"))
    t = d.each(t, "t", f"CASE WHEN {d.matches('t', '^[0-9]+$')} THEN {d.strip_zeros('t')} ELSE t END")
    t = d.each(t, "t", d.lookup("t", W.ADDRESS_WORDS))
    return d.join(d.filter(t, "t", f"NOT {d.one_of('t', W.NUMBER_WORDS)}"))


def ascii(d: Dialect, x: str) -> str:
    return f"(NOT {d.matches(x, '[^\\x00-\\x7F]')})"


@relation(stored=True)
def records(d: Dialect) -> str:
    return f"SELECT country, src, num, {norm_name(d, 'name')} AS name_n, {norm_addr(d, 'address')} AS addr_n, NOT {ascii(d, 'name')} AS name_nonlatin FROM @raw"


# ---- token statistics ----


@relation(stored=True)
def tokens(d: Dialect) -> str:
    """Distinct tokens of every record and field."""
    return f"""SELECT country, src, num, 'name' AS field, tok FROM @records, {d.rows(d.distinct(d.words('name_n')), 'e', 'tok')}
UNION ALL SELECT country, src, num, 'addr' AS field, tok FROM @records, {d.rows(d.distinct(d.words('addr_n')), 'e', 'tok')}"""


@relation()
def sizes(d: Dialect) -> str:
    return "SELECT country, src, count(*) AS n FROM @records GROUP BY country, src"


@relation()
def token_df(d: Dialect) -> str:
    return "SELECT country, field, tok, count(*) AS df FROM @tokens GROUP BY country, field, tok"


@relation(stored=True)
def token_idf(d: Dialect) -> str:
    return """SELECT t.country, t.field, t.tok, t.df, ln(s.n / CAST(t.df AS DOUBLE)) AS idf FROM @token_df t
JOIN (SELECT country, CAST(sum(n) AS DOUBLE) AS n FROM @sizes GROUP BY country) s ON t.country = s.country"""


@relation()
def core_tokens(d: Dialect) -> str:
    return f"""SELECT country, src, num, field, tok, rn FROM
 (SELECT t.*, row_number() OVER (PARTITION BY t.country, t.src, t.num, t.field ORDER BY f.df, t.tok) AS rn
  FROM @tokens t JOIN @token_df f ON t.country = f.country AND t.field = f.field AND t.tok = f.tok
  JOIN (SELECT country, sum(n) AS n FROM @sizes GROUP BY country) s ON t.country = s.country
  WHERE f.df <= CASE WHEN t.field = 'name' THEN {C.name_share} ELSE {C.address_share} END * s.n) x
WHERE rn <= CASE WHEN field = 'name' THEN {C.name_core} ELSE {C.address_core} END"""


@relation()
def core_lists(d: Dialect) -> str:
    """The specific tokens of each record and field as one list, rarest first."""
    agg = "transform(array_sort(collect_list(struct(rn, tok))), x -> x.tok)" if d.spark else "list(tok ORDER BY rn)"
    return f"SELECT country, src, num, field, {agg} AS toks FROM @core_tokens GROUP BY country, src, num, field"


@relation(stored=True)
def keys(d: Dialect) -> str:
    """Keys of names (n, p, x: a token, its start, its end; b: two specific tokens; g: the glued name) and of addresses (a, z:
    a word, a long number; c: two specific tokens): one pass over the tokens, one over the lists of specific ones."""
    digits = d.matches("tok", "^[0-9]+$")
    when = lambda cond, key: f"CASE WHEN {cond} THEN concat({key}) END"
    name = lambda n, key: when(f"field = 'name' AND length(tok) >= {n}", key)
    addr = lambda cond, key: when(f"field = 'addr' AND {cond}", key)
    each = d.array(name(3, "'n', tok"), name(5, "'p', substr(tok, 1, 4)"), name(6, "'x', substr(tok, length(tok) - 3, 4)"), addr(f"length(tok) >= 4 AND NOT {digits}", "'a', tok"), addr(f"length(tok) >= 5 AND {digits}", "'z', tok"))
    mark = "CASE WHEN field = 'name' THEN 'b' ELSE 'c' END"
    if d.spark:
        twos = f"flatten(transform(toks, (x, i) -> transform(slice(toks, i + 2, size(toks)), y -> concat({mark}, x, '_', y))))"
    else:
        twos = f"flatten(list_transform(toks, lambda x, i: list_transform(toks[i + 1:], lambda y: concat({mark}, x, '_', y))))"
    glued = d.join(d.filter(d.words("name_n"), "t", f"NOT {d.one_of('t', W.LEGAL_WORDS)}"), "")
    fam = "CASE WHEN field = 'name' THEN 'n' ELSE 'a' END AS fam"
    return f"""SELECT DISTINCT country, src, num, fam, key FROM (SELECT country, src, num, {fam}, key FROM @tokens, {d.rows(d.filter(each, 'k', 'k IS NOT NULL'), 'e', 'key')}
UNION ALL SELECT country, src, num, {fam}, key FROM @core_lists, {d.rows(twos, 'e', 'key')}
UNION ALL SELECT country, src, num, 'n' AS fam, concat('g', substr(g, 1, 10)) AS key FROM (SELECT country, src, num, {glued} AS g FROM @records) y WHERE length(g) >= 8 AND {ascii(d, 'g')}) x"""


@relation()
def name_keys(d: Dialect) -> str:
    return "SELECT country, src, num, key FROM @keys WHERE fam = 'n'"


@relation()
def addr_keys(d: Dialect) -> str:
    return "SELECT country, src, num, key FROM @keys WHERE fam = 'a'"


# ---- blocking ----


@relation(stored=True)
def block_index(d: Dialect) -> str:
    """Keys of each source that are rare enough, with their weight."""
    return f"""SELECT k.country, k.src, k.fam, k.key, k.df, ln(s.n / CAST(k.df AS DOUBLE)) AS idf FROM
 (SELECT country, src, fam, key, count(*) AS df FROM @keys GROUP BY country, src, fam, key) k
 JOIN @sizes s ON k.country = s.country AND k.src = s.src WHERE k.df <= greatest({C.cap_floor}, floor({C.cap_fraction} * s.n))"""


@relation(stored=True)
def block_mass(d: Dialect) -> str:
    """Weight of every record's keys under the index of a source: its own, or the one that it queries."""
    return """SELECT k.country, k.src, k.num, i.src AS index_src, sum(i.idf * i.idf) AS m, sum(CASE WHEN k.fam = 'a' THEN i.idf * i.idf ELSE 0 END) AS ma
FROM @keys k JOIN @block_index i ON k.country = i.country AND k.fam = i.fam AND k.key = i.key
WHERE k.src = i.src OR k.src = 1 OR i.src = 1 GROUP BY k.country, k.src, k.num, i.src"""


@relation(stored=True)
def block_scores(d: Dialect) -> str:
    """Pairs (query record, record of the queried source) that share indexed keys, with shared weights."""
    return """SELECT country, src, num, index_src, other, sn, sa FROM
 (SELECT q.country, q.src, q.num, i.src AS index_src, t.num AS other, sum(CASE WHEN i.fam = 'n' THEN i.idf * i.idf ELSE 0 END) AS sn, sum(CASE WHEN i.fam = 'a' THEN i.idf * i.idf ELSE 0 END) AS sa
  FROM @keys q JOIN @block_index i ON q.country = i.country AND q.fam = i.fam AND q.key = i.key
  JOIN @keys t ON t.country = i.country AND t.src = i.src AND t.fam = i.fam AND t.key = i.key
  WHERE q.src <> i.src AND (q.src = 1 OR i.src = 1) GROUP BY q.country, q.src, q.num, i.src, t.num) x WHERE sn + sa > 0"""


@relation(stored=True)
def weighed(d: Dialect) -> str:
    """The pools (by all keys and by address keys) out of block_scores, with the masses of both sides."""
    w = "PARTITION BY country, src, num, index_src ORDER BY"
    return f"""SELECT s.*, a.m AS m_q, b.m AS m_t, a.ma AS ma_q, b.ma AS ma_t FROM
 (SELECT * FROM (SELECT *, row_number() OVER ({w} round(sn + sa, 8) DESC, other) AS pool, row_number() OVER ({w} round(sa, 8) DESC, other) AS pool_a FROM @block_scores) r WHERE pool <= {C.pool} OR (sa > 0 AND pool_a <= {C.pool})) s JOIN @block_mass a ON a.country = s.country AND a.src = s.src AND a.num = s.num AND a.index_src = s.index_src
JOIN @block_mass b ON b.country = s.country AND b.src = s.index_src AND b.num = s.other AND b.index_src = s.index_src"""


def _best(where: str, score: str, k: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY country, src, num, index_src ORDER BY round({score}, 8) DESC, other) AS rk FROM @weighed WHERE {where}) x WHERE rk <= {k}"""


COSINE = "(sn + sa) / sqrt(m_q * m_t + 1e-6)"
COSINE_A = "sa / sqrt(ma_q * ma_t + 1e-6)"
FORWARD = "country, num AS s1_num, index_src AS src, other AS b_num"


@relation()
def block_forward(d: Dialect) -> str:
    return _best(f"src = 1 AND pool <= {C.pool}", COSINE, str(C.top_k), FORWARD)


@relation()
def block_jaccard(d: Dialect) -> str:
    return _best(f"src = 1 AND pool <= {C.pool}", "(sn + sa) / (m_q + m_t - sn - sa + 1e-6)", str(C.top_k), FORWARD)


@relation()
def crowded_names(d: Dialect) -> str:
    return "SELECT country, num, count(*) OVER (PARTITION BY country, name_n) AS n FROM @records WHERE src = 1"


@relation()
def block_addr_list(d: Dialect) -> str:
    return f"""SELECT x.country, x.s1_num, x.src, x.b_num FROM (SELECT country, num AS s1_num, index_src AS src, other AS b_num, row_number() OVER (PARTITION BY country, num, index_src ORDER BY round({COSINE_A}, 8) DESC, other) AS rk
 FROM @weighed WHERE src = 1 AND sa > 0 AND pool_a <= {C.pool}) x JOIN @crowded_names c ON c.country = x.country AND c.num = x.s1_num
WHERE rk <= CASE WHEN c.n >= {C.crowded} THEN {C.address_k_crowded} ELSE {C.address_k} END"""


@relation()
def block_reverse(d: Dialect) -> str:
    return _best(f"src <> 1 AND pool <= {C.pool}", COSINE, str(C.reverse_k), "country, other AS s1_num, src, num AS b_num")


@relation()
def block_union(d: Dialect) -> str:
    return "SELECT * FROM @block_forward UNION SELECT * FROM @block_addr_list UNION SELECT * FROM @block_reverse"


def _rescored(pairs: str) -> str:
    return f"""SELECT p.country, p.s1_num, p.src, p.b_num, coalesce(s.sn, 0) AS sn, coalesce(s.sa, 0) AS sa,
 (coalesce(s.sn, 0) + coalesce(s.sa, 0)) / (coalesce(a.m, 0) + coalesce(b.m, 0) - coalesce(s.sn, 0) - coalesce(s.sa, 0) + 1e-6) AS sj
FROM {pairs} p LEFT JOIN @block_scores s ON s.src = 1 AND s.country = p.country AND s.num = p.s1_num AND s.index_src = p.src AND s.other = p.b_num
LEFT JOIN @block_mass a ON a.src = 1 AND a.country = p.country AND a.num = p.s1_num AND a.index_src = p.src
LEFT JOIN @block_mass b ON b.src = p.src AND b.index_src = p.src AND b.country = p.country AND b.num = p.b_num"""


@relation(stored=True)
def scored(d: Dialect) -> str:
    return _rescored("@block_union")


@relation()
def candidates(d: Dialect) -> str:
    return "SELECT country, s1_num, src, b_num, round(sn, 6) AS sn, round(sa, 6) AS sa, round(sj, 6) AS sj FROM @scored"


@relation()
def block_recall(d: Dialect) -> str:
    return """SELECT count(*) AS n_true, CAST(sum(CASE WHEN c.b_num IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_found,
 round(sum(CASE WHEN c.b_num IS NOT NULL THEN 1 ELSE 0 END) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS recall,
 round((SELECT count(*) FROM @scored) / CAST((SELECT count(*) FROM @records WHERE src = 1) AS DOUBLE), 6) AS per_s1
FROM @truth t LEFT JOIN @scored c ON c.country = t.country AND c.s1_num = t.s1_num AND c.src = t.src AND c.b_num = t.b_num"""


@relation()
def pair_dot_product(d: Dialect) -> str:
    """Shared weights of given pairs (the true ones)."""
    return f"SELECT country, s1_num, src, b_num, round(sn, 6) AS sn, round(sa, 6) AS sa, round(sj, 6) AS sj FROM ({_rescored('@truth')}) x"


@relation()
def block_channels(d: Dialect) -> str:
    """Best by name keys only and by address keys only."""
    name = _best(f"src = 1 AND sn > 0 AND pool <= {C.pool}", "sn / sqrt((m_q - ma_q) * (m_t - ma_t) + 1e-6)", "10", f"{FORWARD}, 'name' AS channel")
    addr = _best(f"src = 1 AND sa > 0 AND pool_a <= {C.pool}", COSINE_A, "10", f"{FORWARD}, 'addr' AS channel")
    return f"{name} UNION ALL {addr}"


@relation()
def siblings(d: Dialect) -> str:
    """Records of one source that share keys, by cosine."""
    return """SELECT s.country, s.src, s.a, s.b, s.p / sqrt(x.m * y.m + 1e-6) AS cos FROM
 (SELECT a.country, a.src, a.num AS a, b.num AS b, sum(i.idf * i.idf) AS p FROM @keys a JOIN @block_index i ON a.country = i.country AND a.src = i.src AND a.fam = i.fam AND a.key = i.key
  JOIN @keys b ON b.country = i.country AND b.src = i.src AND b.fam = i.fam AND b.key = i.key WHERE a.num <> b.num AND a.src <> 1 GROUP BY a.country, a.src, a.num, b.num) s
JOIN @block_mass x ON x.country = s.country AND x.src = s.src AND x.index_src = s.src AND x.num = s.a JOIN @block_mass y ON y.country = s.country AND y.src = s.src AND y.index_src = s.src AND y.num = s.b"""


@relation()
def block_siblings(d: Dialect) -> str:
    """Three nearest neighbours of each record's two best candidates."""
    return """SELECT DISTINCT q.country, q.s1_num, q.src, n.b AS b_num FROM
 (SELECT *, row_number() OVER (PARTITION BY country, s1_num, src ORDER BY round(sj, 8) DESC, b_num) AS rk FROM @scored) q
 JOIN (SELECT *, row_number() OVER (PARTITION BY country, src, a ORDER BY round(cos, 8) DESC, b) AS nk FROM @siblings WHERE round(cos, 8) >= 0.6) n
 ON n.country = q.country AND n.src = q.src AND n.a = q.b_num WHERE q.rk <= 2 AND n.nk <= 3"""


@relation()
def typo_keys(d: Dialect) -> str:
    """Of the two rarest specific tokens, those of 5 to 12 plain letters: the consonant skeleton without doubles, if it has 4
    letters, the token, and its one-letter deletions."""
    skeleton = f"concat(substr(tok, 1, 1), {d.replace('substr(tok, 2)', '[aeiou]')})"
    for c in "bcdfghjklmnpqrstvwxyz":
        skeleton = d.replace(skeleton, f"{c}{c}+", c)
    plain = f"(SELECT country, src, num, tok FROM @core_tokens WHERE field = 'name' AND rn <= 2 AND length(tok) BETWEEN 5 AND 12 AND {d.matches('tok', '^[a-z]+$')})"
    return f"""SELECT DISTINCT country, src, num, key FROM (SELECT country, src, num, concat('k', sk) AS key FROM (SELECT country, src, num, {skeleton} AS sk FROM {plain} x) y WHERE length(sk) >= 4
UNION ALL SELECT country, src, num, concat('d', tok) AS key FROM {plain} x
UNION ALL SELECT country, src, num, concat('d', substr(tok, 1, k - 1), substr(tok, k + 1)) AS key FROM {plain} x, {d.rows(d.series('CAST(1 AS INT)', 'CAST(length(tok) AS INT)'), 'e', 'k')}) z"""


@relation()
def address_first_keys(d: Dialect) -> str:
    """House number with the rarest word of the address, and long numbers."""
    return f"""SELECT DISTINCT country, src, num, key FROM (SELECT w.country, w.src, w.num, concat('H', w.tok, '_', n.tok) AS key FROM
 (SELECT t.country, t.src, t.num, t.tok, row_number() OVER (PARTITION BY t.country, t.src, t.num ORDER BY f.df, t.tok) AS rn FROM @tokens t JOIN @token_df f ON f.country = t.country AND f.field = t.field AND f.tok = t.tok
  WHERE t.field = 'addr' AND NOT {d.matches('t.tok', '[0-9]')} AND f.df <= 50) w
 JOIN @tokens n ON n.country = w.country AND n.src = w.src AND n.num = w.num AND n.field = 'addr' AND {d.matches('n.tok', '^[0-9]+$')} WHERE w.rn = 1
UNION ALL SELECT country, src, num, concat('P', tok) AS key FROM @tokens WHERE field = 'addr' AND {d.matches('tok', '^[0-9]{5,}$')}) z"""


@relation()
def block_address_first(d: Dialect) -> str:
    return """SELECT DISTINCT a.country, a.num AS s1_num, b.src, b.num AS b_num FROM @address_first_keys a JOIN @address_first_keys b ON a.country = b.country AND a.key = b.key WHERE a.src = 1 AND b.src <> 1"""


@relation()
def split_numbers(d: Dialect) -> str:
    return f"SELECT country, src, num, {d.join(numbers(d, 'addr_n'), ',')} AS numbers FROM @records"


def numbers(d: Dialect, x: str) -> str:
    """Numbers of an address, letters before digits split off, without leading zeros."""
    parts = d.filter(d.words(d.replace(x, "([a-z])([0-9])", "\\1 ").replace("$1 ", "$1 $2").replace("\\1 ", "\\1 \\2")), "t", d.matches("t", "^[0-9]+$"))
    return d.each(parts, "t", d.strip_zeros("t"))


# ---- pair features ----


@relation(stored=True)
def pairs(d: Dialect) -> str:
    """Candidates with both records and the label."""
    return """SELECT c.country, c.s1_num, c.src, c.b_num, c.sn, c.sa, c.sj, a.name_n AS na, b.name_n AS nb, a.addr_n AS aa, b.addr_n AS ab, b.name_nonlatin AS nonlatin_b, t.b_num IS NOT NULL AS y
FROM @scored c JOIN @records a ON a.src = 1 AND a.country = c.country AND a.num = c.s1_num JOIN @records b ON b.src = c.src AND b.country = c.country AND b.num = c.b_num
LEFT JOIN @truth t ON t.country = c.country AND t.s1_num = c.s1_num AND t.src = c.src AND t.b_num = c.b_num"""


@relation()
def token_weights(d: Dialect) -> str:
    """Weight of each record's tokens: all, and number and list of those that are specific."""
    return """SELECT t.country, t.src, t.num, t.field, sum(f.idf) AS w, CAST(sum(CASE WHEN f.idf > 2.5 THEN 1 ELSE 0 END) AS BIGINT) AS core
FROM @tokens t JOIN @token_idf f ON f.country = t.country AND f.field = t.field AND f.tok = t.tok GROUP BY t.country, t.src, t.num, t.field"""


@relation(stored=True)
def shared_weights(d: Dialect) -> str:
    """Weight and number of the tokens that a candidate pair shares, by field."""
    return """SELECT p.country, p.s1_num, p.src, p.b_num, a.field, sum(f.idf) AS w, CAST(sum(CASE WHEN f.idf > 2.5 THEN 1 ELSE 0 END) AS BIGINT) AS core
FROM @scored p JOIN @tokens a ON a.src = 1 AND a.country = p.country AND a.num = p.s1_num
JOIN @tokens b ON b.src = p.src AND b.country = p.country AND b.num = p.b_num AND b.field = a.field AND b.tok = a.tok
JOIN @token_idf f ON f.country = a.country AND f.field = a.field AND f.tok = a.tok GROUP BY p.country, p.s1_num, p.src, p.b_num, a.field"""


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"


def _share(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / greatest(CAST({b} AS DOUBLE), 1)"


PAIR = "country, s1_num, src, b_num"


def _has_number(d: Dialect, arr: str) -> str:
    return d.filter(arr, "t", d.matches("t", "[0-9]"))


@relation(stored=True)
def pair_features(d: Dialect) -> str:
    """Token, number and edit features of candidate pairs; address features are null where an address is missing."""
    similar = lambda x, y: f"(1.0 - {d.edits(x, y)} / CAST(greatest(length({x}), length({y}), 1) AS DOUBLE))"
    ok = "a_missing = 0"
    when = lambda x: f"CASE WHEN {ok} THEN {x} END"
    best = d.largest(d.each("slice6_a", "u", d.largest(d.each("slice6_b", "v", similar("u", "v")))))
    return f"""SELECT {PAIR}, y, sn, sa, sj, sn + sa AS s_tot, {_flag('src = 3')} AS is_s3, {_flag('nonlatin_b')} AS n_nonlatin_b, na, nb, aa, ab,
 CAST(a_missing AS DOUBLE) AS a_missing, {similar('na', 'nb')} AS n_lev,
 {_share(d.both('ta', 'tb'), d.either('ta', 'tb'))} AS n_jac, {_share('core_s', 'core_na + core_nb - core_s')} AS n_core_jac,
 CAST(core_s AS DOUBLE) AS n_core_ov, CAST(core_na AS DOUBLE) AS n_core_a, CAST(core_nb AS DOUBLE) AS n_core_b,
 coalesce(w_ns / nullif(w_na, 0), 0) AS n_cov_a, coalesce(w_ns / nullif(w_nb, 0), 0) AS n_cov_b,
 {_flag(f"{d.at('ta', '1')} = {d.at('tb', '1')}")} AS n_first_eq, {_flag(f"{d.at('ta', d.size('ta'))} = {d.at('tb', d.size('tb'))}")} AS n_last_eq,
 CAST(least(length(na), length(nb)) AS DOUBLE) / greatest(length(na), length(nb), 1) AS n_len_ratio,
 CAST({d.size(d.filter('tb', 't', 'NOT ' + ascii(d, 't')))} AS DOUBLE) AS n_untrans_b,
 {when(_share(d.both('ua', 'ub'), d.either('ua', 'ub')))} AS a_jac, {when('coalesce(w_as / nullif(w_aa, 0), 0)')} AS a_cov_a, {when('coalesce(w_as / nullif(w_ab, 0), 0)')} AS a_cov_b,
 {when(f"CAST({d.both('da', 'db')} AS DOUBLE)")} AS a_num_ov, {when(_share(d.both('da', 'db'), d.either('da', 'db')))} AS a_num_jac,
 {when(f"CAST({d.size(d.distinct('da'))} AS DOUBLE)")} AS a_num_a, {when(f"CAST({d.size(d.distinct('db'))} AS DOUBLE)")} AS a_num_b,
 {when(_flag(f"{d.size('da')} > 0 AND {d.has('db', d.at('da', '1'))}"))} AS a_first_num_eq,
 {when(_flag(f"{d.size(d.filter('da', 't', d.has('db', 't') + ' AND ' + d.matches('t', '^[0-9]{5,6}$')))} > 0"))} AS a_postal_eq,
 {when(_flag(f"{d.at('ua', d.size('ua'))} = {d.at('ub', d.size('ub'))}"))} AS a_last_eq,
 {when(f"CAST({d.size('ua')} AS DOUBLE)")} AS a_tok_a, {when(f"CAST({d.size('ub')} AS DOUBLE)")} AS a_tok_b,
 {when(_share(d.both('xa', 'xb'), d.either('xa', 'xb')))} AS a_num_split_jac,
 CASE WHEN {ok} AND {d.size('xa')} > 0 AND {d.size('xb')} > 0 THEN {similar(d.at('xa', '1'), d.at('xb', '1'))} END AS a_first_num_sim,
 CASE WHEN {ok} AND {d.size('xa')} > 0 AND {d.size('xb')} > 0 THEN {best} END AS a_num_best_sim,
 CASE WHEN {ok} AND {d.size('xa')} > 0 AND {d.size('xb')} > 0 THEN ln(1.0 + abs(CAST(substr({d.at('xa', '1')}, 1, 9) AS BIGINT) - CAST(substr({d.at('xb', '1')}, 1, 9) AS BIGINT))) END AS a_first_num_logdiff
FROM (SELECT z.*, {d.slice('xa', 1, 6)} AS slice6_a, {d.slice('xb', 1, 6)} AS slice6_b FROM (SELECT p.*, CASE WHEN p.aa = '' OR p.ab = '' THEN 1 ELSE 0 END AS a_missing, {d.words('p.na')} AS ta, {d.words('p.nb')} AS tb, {d.words('p.aa')} AS ua, {d.words('p.ab')} AS ub,
  {_has_number(d, d.words('p.aa'))} AS da, {_has_number(d, d.words('p.ab'))} AS db, {numbers(d, 'p.aa')} AS xa, {numbers(d, 'p.ab')} AS xb,
  coalesce(n.w, 0) AS w_ns, coalesce(n.core, 0) AS core_s, coalesce(m.w, 0) AS w_as, coalesce(wa.w, 0) AS w_na, coalesce(wb.w, 0) AS w_nb, coalesce(wa.core, 0) AS core_na, coalesce(wb.core, 0) AS core_nb, coalesce(va.w, 0) AS w_aa, coalesce(vb.w, 0) AS w_ab
 FROM @pairs p
 LEFT JOIN @shared_weights n ON n.field = 'name' AND n.country = p.country AND n.s1_num = p.s1_num AND n.src = p.src AND n.b_num = p.b_num
 LEFT JOIN @shared_weights m ON m.field = 'addr' AND m.country = p.country AND m.s1_num = p.s1_num AND m.src = p.src AND m.b_num = p.b_num
 LEFT JOIN @token_weights wa ON wa.field = 'name' AND wa.src = 1 AND wa.country = p.country AND wa.num = p.s1_num
 LEFT JOIN @token_weights wb ON wb.field = 'name' AND wb.src = p.src AND wb.country = p.country AND wb.num = p.b_num
 LEFT JOIN @token_weights va ON va.field = 'addr' AND va.src = 1 AND va.country = p.country AND va.num = p.s1_num
 LEFT JOIN @token_weights vb ON vb.field = 'addr' AND vb.src = p.src AND vb.country = p.country AND vb.num = p.b_num) z) x"""


TOKEN_FEATURES = ("s_tot", "is_s3", "n_nonlatin_b", "a_missing", "n_jac", "n_core_jac", "n_core_ov", "n_core_a", "n_core_b", "n_cov_a", "n_cov_b", "n_first_eq", "n_last_eq", "n_len_ratio", "n_untrans_b", "a_jac", "a_cov_a", "a_cov_b", "a_num_ov", "a_num_jac", "a_num_a", "a_num_b", "a_first_num_eq", "a_postal_eq", "a_last_eq", "a_tok_a", "a_tok_b", "a_num_split_jac", "a_first_num_logdiff")
EDIT_FEATURES = ("n_lev", "a_first_num_sim", "a_num_best_sim")
STRING_FEATURES = ("n_ratio", "n_tsort", "n_tset", "a_ratio", "a_tsort", "a_tset")
WINDOW_FEATURES = ("n_partial", "n_jw")


@relation()
def pair_features_tokens(d: Dialect) -> str:
    return f"SELECT {PAIR}, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in TOKEN_FEATURES) + " FROM @pair_features"


@relation()
def pair_features_edit(d: Dialect) -> str:
    return f"SELECT {PAIR}, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in EDIT_FEATURES) + " FROM @pair_features"


@relation(stored=True)
def text_ratios(d: Dialect) -> str:
    """Ratios of the distinct texts that candidates put side by side: each two are compared once, whatever pairs have them."""
    return f"""SELECT field, x, y, {d.indel('x', 'y')} AS r, {d.token_sort('x', 'y')} AS tsort, {d.token_set('x', 'y')} AS tset FROM
 (SELECT DISTINCT 'name' AS field, na AS x, nb AS y FROM @pairs UNION ALL SELECT DISTINCT 'addr' AS field, aa AS x, ab AS y FROM @pairs WHERE aa <> '' AND ab <> '') t"""


@relation(stored=True)
def pair_strings(d: Dialect) -> str:
    """Ratios of names, and of addresses where both stand."""
    return f"""SELECT p.country, p.s1_num, p.src, p.b_num, n.r AS n_ratio, n.tsort AS n_tsort, n.tset AS n_tset, a.r AS a_ratio, a.tsort AS a_tsort, a.tset AS a_tset FROM @pairs p
JOIN @text_ratios n ON n.field = 'name' AND n.x = p.na AND n.y = p.nb LEFT JOIN @text_ratios a ON a.field = 'addr' AND a.x = p.aa AND a.y = p.ab"""


@relation(spark_only=True, stored=True)
def pair_windows(d: Dialect) -> str:
    """Window and Jaro-Winkler ratios of names, each two distinct names compared once."""
    return f"""SELECT {PAIR}, r.n_partial, r.n_jw FROM @pairs p JOIN (SELECT x, y, partial_ratio(x, y) AS n_partial, jaro_winkler(x, y) AS n_jw FROM (SELECT DISTINCT na AS x, nb AS y FROM @pairs) t) r ON r.x = p.na AND r.y = p.nb"""


@relation()
def pair_features_strings(d: Dialect) -> str:
    return f"SELECT {PAIR}, " + ", ".join(f"round({c}, 6) AS {c}" for c in STRING_FEATURES) + " FROM @pair_strings"


@relation(spark_only=True)
def pair_features_windows(d: Dialect) -> str:
    return f"SELECT {PAIR}, round(n_partial, 6) AS n_partial, round(n_jw, 6) AS n_jw FROM @pair_windows"


@relation()
def jaro_winkler_names(d: Dialect) -> str:
    f = "jaro_winkler(na, nb)" if d.spark else "jaro_winkler_similarity(na, nb)"
    return f"SELECT {PAIR}, round({f}, 6) AS n_jw FROM @pairs WHERE na <> '' AND nb <> '' AND {ascii(d, 'na')} AND {ascii(d, 'nb')}"


# ---- competition among candidates, reference score, context ----


@relation(stored=True)
def competition(d: Dialect) -> str:
    return """SELECT x.*, CASE WHEN first_b IS NULL THEN NULL ELSE first_b - coalesce(second_b, 0) END AS gap_b FROM
 (SELECT r.*, sj / nullif(max(sj) OVER (PARTITION BY country, s1_num, src), 0) AS ratio_best_s1, count(*) OVER (PARTITION BY country, s1_num, src) AS n_cand_s1,
  sj / nullif(max(sj) OVER (PARTITION BY country, src, b_num), 0) AS ratio_best_b, count(*) OVER (PARTITION BY country, src, b_num) AS n_s1_for_b,
  max(sj) OVER (PARTITION BY country, src, b_num) AS first_b, max(CASE WHEN rank_b = 2 THEN sj END) OVER (PARTITION BY country, src, b_num) AS second_b FROM
  (SELECT s.country, s.s1_num, s.src, s.b_num, s.sj, c.n AS s1_name_dup, row_number() OVER (PARTITION BY s.country, s.s1_num, s.src ORDER BY round(s.sj, 8) DESC, s.b_num) AS rank_s1,
   row_number() OVER (PARTITION BY s.country, s.src, s.b_num ORDER BY round(s.sj, 8) DESC, s.s1_num) AS rank_b FROM @scored s JOIN @crowded_names c ON c.country = s.country AND c.num = s.s1_num) r) x"""


@relation()
def competition_features(d: Dialect) -> str:
    return f"""SELECT {PAIR}, CAST(rank_s1 AS BIGINT) AS rank_s1, round(ratio_best_s1, 6) AS ratio_best_s1, n_cand_s1, CAST(rank_b AS BIGINT) AS rank_b, round(ratio_best_b, 6) AS ratio_best_b, n_s1_for_b, round(gap_b, 6) AS gap_b, s1_name_dup FROM @competition"""


@relation(stored=True)
def predicted(d: Dialect) -> str:
    """A fixed logistic score of a few features, in place of a trained model's."""
    z = "4.0 * f.n_jac + 3.0 * f.n_cov_b + 2.0 * coalesce(f.a_jac, 0) + 2.0 * coalesce(c.ratio_best_b, 0) - 6.0"
    return f"""SELECT f.country, f.s1_num, f.src, f.b_num, f.y, round(1.0 / (1.0 + exp(-({z}))), 6) AS p, f.na, f.nb, f.aa, f.ab, f.n_jac, f.a_jac, f.a_missing,
 (f.s1_num * 2654435761) % 4294967296 / CAST(4294967296 AS DOUBLE) AS u FROM @pair_features f JOIN @competition c ON c.country = f.country AND c.s1_num = f.s1_num AND c.src = f.src AND c.b_num = f.b_num"""


@relation(stored=True)
def context(d: Dialect) -> str:
    """What the other candidates of a record and of its partner score; the anchor is the record's best other candidate."""
    s1 = "PARTITION BY country, s1_num"
    b = "PARTITION BY country, src, b_num"
    n = lambda cond, w: f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER ({w}) AS BIGINT)"
    own = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END"
    top = lambda k, c: f"max(CASE WHEN rk = {k} THEN {c} END) OVER ({s1})"
    pick = lambda c: f"CASE WHEN rk = 1 THEN {top(2, c)} ELSE {top(1, c)} END"
    return f"""SELECT *, CASE WHEN anchor_src IS NULL THEN NULL WHEN anchor_src = src THEN 1.0 ELSE 0.0 END AS anchor_same_src FROM (SELECT r.*, p AS p1, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS logit_p1,
 sum(p) OVER ({s1}) - p AS s1_p_sum_other, {n('p >= 0.5', s1)} - {own('p >= 0.5')} AS s1_n50_other, {n('p >= 0.9', s1)} - {own('p >= 0.9')} AS s1_n90_other,
 {n('p >= 0.5 AND src = 2', s1)} AS s1_n50_s2, {n('p >= 0.5 AND src = 3', s1)} AS s1_n50_s3,
 {n('p >= 0.5', s1 + ', src')} - {own('p >= 0.5')} AS s1_n50_same_src, {n('p >= 0.5', s1)} - {n('p >= 0.5', s1 + ', src')} AS s1_n50_other_src, {n('p >= 0.9', s1 + ', src')} - {own('p >= 0.9')} AS s1_n90_same_src,
 rk AS s1_rank_p, p / greatest(max(p) OVER ({s1}), 1e-6) AS p_over_s1_max, coalesce({pick('p')}, 0) AS s1_p_max_other, {pick('src')} AS anchor_src, {pick('b_num')} AS anchor_b,
 bk AS b_rank_p, count(*) OVER ({b}) AS b_n_s1, coalesce(CASE WHEN bk = 1 THEN max(CASE WHEN bk = 2 THEN p END) OVER ({b}) ELSE max(CASE WHEN bk = 1 THEN p END) OVER ({b}) END, 0) AS b_p_max_other
 FROM (SELECT country, s1_num, src, b_num, p, row_number() OVER ({s1} ORDER BY p DESC, src, b_num) AS rk, row_number() OVER ({b} ORDER BY p DESC, s1_num) AS bk FROM @predicted) r) x"""


CONTEXT = ("p1", "logit_p1", "s1_p_sum_other", "s1_n50_other", "s1_n90_other", "s1_n50_s2", "s1_n50_s3", "s1_n50_same_src", "s1_n50_other_src", "s1_n90_same_src", "s1_rank_p", "p_over_s1_max", "s1_p_max_other", "anchor_same_src", "b_rank_p", "b_n_s1", "b_p_max_other")


@relation()
def context_features(d: Dialect) -> str:
    return f"SELECT {PAIR}, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in CONTEXT) + " FROM @context"


@relation()
def anchors(d: Dialect) -> str:
    """Texts of each candidate and of its anchor."""
    return """SELECT c.country, c.s1_num, c.src, c.b_num, c.anchor_src, c.anchor_b, a.name_n AS na, a.addr_n AS aa, b.name_n AS nb, b.addr_n AS ab FROM @context c
JOIN @records b ON b.country = c.country AND b.src = c.src AND b.num = c.b_num LEFT JOIN @records a ON a.country = c.country AND a.src = c.anchor_src AND a.num = c.anchor_b"""


@relation()
def anchor_tokens(d: Dialect) -> str:
    w = d.words
    return f"""SELECT {PAIR}, CASE WHEN na IS NOT NULL THEN round({_share(d.both('x', 'y'), d.either('x', 'y'))}, 6) END AS anc_n_jac, CASE WHEN aa <> '' AND ab <> '' THEN round({_share(d.both('u', 'v'), d.either('u', 'v'))}, 6) END AS anc_a_jac
FROM (SELECT t.*, {w("coalesce(na, '')")} AS x, {w('nb')} AS y, {w("coalesce(aa, '')")} AS u, {w('ab')} AS v FROM @anchors t) z"""


@relation(stored=True)
def anchor_weights(d: Dialect) -> str:
    """Weight of the tokens that a candidate shares with its anchor, by field."""
    return """SELECT p.country, p.s1_num, p.src, p.b_num, a.field, sum(f.idf) AS w FROM @context p JOIN @tokens a ON a.src = p.anchor_src AND a.country = p.country AND a.num = p.anchor_b
JOIN @tokens b ON b.src = p.src AND b.country = p.country AND b.num = p.b_num AND b.field = a.field AND b.tok = a.tok
JOIN @token_idf f ON f.country = a.country AND f.field = a.field AND f.tok = a.tok GROUP BY p.country, p.s1_num, p.src, p.b_num, a.field"""


#: Features of a candidate against its anchor, named as those of a pair.
ANCHOR = ("n_ratio", "n_tsort", "n_tset", "n_jw", "n_cov_a", "n_cov_b", "a_missing", "a_ratio", "a_tsort", "a_tset", "a_jac", "a_cov_a", "a_cov_b", "a_num_jac", "a_first_num_eq", "a_postal_eq", "a_last_eq")


def _anchored(d: Dialect, names: tuple[str, ...]) -> str:
    ok = "na IS NOT NULL AND aa <> '' AND ab <> ''"
    n = lambda x: f"CASE WHEN na IS NOT NULL THEN {x} END"
    a = lambda x: f"CASE WHEN {ok} THEN {x} END"
    postal = d.size(d.filter("da", "t", d.has("db", "t") + " AND " + d.matches("t", "^[0-9]{5,6}$")))
    every = {
        "n_ratio": n(d.indel("coalesce(na, '')", "nb")), "n_tsort": n(d.token_sort("coalesce(na, '')", "nb")), "n_tset": n(d.token_set("coalesce(na, '')", "nb")), "n_jw": n("jaro_winkler(coalesce(na, ''), nb)"),
        "n_cov_a": n("coalesce(w_n / nullif(w_na, 0), 0)"), "n_cov_b": n("coalesce(w_n / nullif(w_nb, 0), 0)"), "a_missing": n(_flag("aa = '' OR ab = ''")),
        "a_ratio": a(d.indel("coalesce(aa, '')", "ab")), "a_tsort": a(d.token_sort("coalesce(aa, '')", "ab")), "a_tset": a(d.token_set("coalesce(aa, '')", "ab")),
        "a_jac": a(_share(d.both("ua", "ub"), d.either("ua", "ub"))), "a_cov_a": a("coalesce(w_a / nullif(w_aa, 0), 0)"), "a_cov_b": a("coalesce(w_a / nullif(w_ab, 0), 0)"),
        "a_num_jac": a(_share(d.both("da", "db"), d.either("da", "db"))), "a_first_num_eq": a(_flag(f"{d.size('da')} > 0 AND {d.has('db', d.at('da', '1'))}")), "a_postal_eq": a(_flag(f"{postal} > 0")),
        "a_last_eq": a(_flag(f"{d.at('ua', d.size('ua'))} = {d.at('ub', d.size('ub'))}")),
    }
    w = d.words
    columns = ", ".join(f"round(CAST({every[c]} AS DOUBLE), 6) AS anc_{c}" for c in names)
    return f"""SELECT {PAIR}, {columns} FROM (SELECT t.country, t.s1_num, t.src, t.b_num, t.na, t.aa, t.nb, t.ab, {w("coalesce(t.aa, '')")} AS ua, {w('t.ab')} AS ub, {_has_number(d, w("coalesce(t.aa, '')"))} AS da, {_has_number(d, w('t.ab'))} AS db,
  coalesce(n.w, 0) AS w_n, coalesce(m.w, 0) AS w_a, coalesce(wa.w, 0) AS w_na, coalesce(wb.w, 0) AS w_nb, coalesce(va.w, 0) AS w_aa, coalesce(vb.w, 0) AS w_ab FROM @anchors t
 LEFT JOIN @anchor_weights n ON n.field = 'name' AND n.country = t.country AND n.s1_num = t.s1_num AND n.src = t.src AND n.b_num = t.b_num
 LEFT JOIN @anchor_weights m ON m.field = 'addr' AND m.country = t.country AND m.s1_num = t.s1_num AND m.src = t.src AND m.b_num = t.b_num
 LEFT JOIN @token_weights wa ON wa.field = 'name' AND wa.src = t.anchor_src AND wa.country = t.country AND wa.num = t.anchor_b
 LEFT JOIN @token_weights wb ON wb.field = 'name' AND wb.src = t.src AND wb.country = t.country AND wb.num = t.b_num
 LEFT JOIN @token_weights va ON va.field = 'addr' AND va.src = t.anchor_src AND va.country = t.country AND va.num = t.anchor_b
 LEFT JOIN @token_weights vb ON vb.field = 'addr' AND vb.src = t.src AND vb.country = t.country AND vb.num = t.b_num) z"""


@relation()
def anchor_features(d: Dialect) -> str:
    """A candidate against its record's best other candidate; all null without one, address features where one is missing."""
    return _anchored(d, tuple(c for c in ANCHOR if c != "n_jw"))


@relation(spark_only=True)
def anchor_names(d: Dialect) -> str:
    return _anchored(d, ("n_jw",))
