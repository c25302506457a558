"""Relations for learned maps (what they are learned from, maps of names and addresses, records with maps applied), and for
samples, orders and reports over all candidates."""

from __future__ import annotations

from ..config import DEFAULT as C
from .decisions import ORDER, alias_counts_of, lexicon_of, lexicon_pairs_of, lowest, missing_of, places_of, ranked
from .dialect import Dialect
from .relations import PAIR, relation

# ---- learned maps ----


@relation()
def learning_truth(d: Dialect) -> str:
    """True pairs that maps of a country are learned from: none of a held-out record, and at most so many, those with the lowest
    hash."""
    u = "(s1_num * 2654435761) % 4294967296 / CAST(4294967296 AS DOUBLE)"
    rows = f"(SELECT {PAIR}, {ORDER} AS o FROM @truth WHERE NOT ({u} >= {C.hold_from * C.hold} AND {u} < {C.hold})) x"
    return f"SELECT {PAIR} FROM ({lowest(rows, 'country', str(C.learn_pairs), 's1_num, src, b_num')}) y"


@relation()
def addr_places(d: Dialect) -> str:
    """Tokens of addresses with their places."""
    return places_of(d, "addr_n")


@relation()
def addr_lexicon_pairs(d: Dialect) -> str:
    return lexicon_pairs_of(d, "@learning_truth", "@addr_places")


@relation()
def learn_addr_lexicon(d: Dialect) -> str:
    """Replacements of address tokens beyond ASCII, by country."""
    return lexicon_of("@addr_lexicon_pairs", "country")


@relation()
def missing_name_tokens(d: Dialect) -> str:
    return missing_of(d, "name_n")


@relation()
def name_alias_counts(d: Dialect) -> str:
    return alias_counts_of(d, "@missing_name_tokens")


@relation()
def learn_name_alias(d: Dialect) -> str:
    """Aliases in names: spelling variants only, without chains."""
    good = f"(SELECT country, tok, repl, n, c FROM @name_alias_counts WHERE n >= {C.alias_count} AND tok <> repl AND c / CAST(n AS DOUBLE) >= {C.alias_precision} AND {d.indel('tok', 'repl')} >= {C.alias_typo})"
    return f"SELECT a.country, a.tok, a.repl, a.n, a.c FROM {good} a LEFT JOIN {good} b ON b.country = a.country AND b.tok = a.repl WHERE b.tok IS NULL"


@relation()
def fixed_addr_tokens(d: Dialect) -> str:
    """As fixed_tokens, for addresses: a caller gives this relation."""
    return "SELECT country, addr_n AS tok, addr_n AS repl FROM @records WHERE 1 = 0"


def _overridden(*maps: str) -> str:
    """One replacement for each country and token, out of the last map that has it."""
    every = " UNION ALL ".join(f"SELECT country, tok, repl, {k} AS pri FROM {m}" for k, m in enumerate(maps))
    return f"SELECT country, tok, repl FROM (SELECT country, tok, repl, row_number() OVER (PARTITION BY country, tok ORDER BY pri DESC, repl) AS rk FROM ({every}) x) y WHERE rk = 1"


@relation()
def name_map(d: Dialect) -> str:
    return _overridden("@learn_name_alias", "@fixed_tokens")


@relation()
def address_map(d: Dialect) -> str:
    return _overridden("@learn_addr_lexicon", "@learn_alias", "@fixed_addr_tokens")


@relation()
def mapped_records(d: Dialect) -> str:
    """Records with learned replacements: the lexicon in names (not those of source 1; its tokens are all beyond ASCII), then
    the map of names; the map of addresses."""
    agg = "array_join(transform(array_sort(collect_list(struct(k, t))), x -> x.t), ' ')" if d.spark else "string_agg(t, ' ' ORDER BY k)"
    told = "(SELECT p.country, p.src, p.num, p.k, CASE WHEN p.src <> 1 THEN coalesce(l.repl, p.tok) ELSE p.tok END AS tok FROM @name_places p LEFT JOIN @learn_lexicon l ON l.tok = p.tok)"

    def mapped(places: str, by: str) -> str:
        return f"(SELECT country, src, num, {agg} AS mapped FROM (SELECT x.country, x.src, x.num, x.k, coalesce(m.repl, x.tok) AS t FROM {places} x LEFT JOIN {by} m ON m.country = x.country AND m.tok = x.tok) y GROUP BY country, src, num)"

    return f"""SELECT r.country, r.src, r.num, coalesce(n.mapped, '') AS name_n, coalesce(a.mapped, '') AS addr_n, r.name_nonlatin FROM @records r
LEFT JOIN {mapped(told, '@name_map')} n ON n.country = r.country AND n.src = r.src AND n.num = r.num
LEFT JOIN {mapped('@addr_places', '@address_map')} a ON a.country = r.country AND a.src = r.src AND a.num = r.num"""


# ---- samples, orders, reports over all candidates ----


@relation()
def fixed_sample(d: Dialect) -> str:
    """A sample of fixed size without replacement: the pairs with the lowest hash."""
    return f"SELECT {PAIR}, p FROM ({lowest(f'(SELECT {PAIR}, p, {ORDER} AS o FROM @predicted) x', '1', str(C.sample), 'country, s1_num, src, b_num')}) y"


@relation()
def shuffled(d: Dialect) -> str:
    """Every pair with its place in a shuffle: the order of hashes, found through counts of hash ranges."""
    rows = f"(SELECT *, CAST(floor(o / 1048576.0) AS BIGINT) AS part FROM (SELECT {PAIR}, {ORDER} AS o FROM @predicted) q) x"
    return f"SELECT {PAIR}, CAST(rk AS BIGINT) AS place FROM ({ranked(rows, '1', 'o, country, s1_num, src, b_num')}) y"


@relation()
def length_batches(d: Dialect) -> str:
    """Every pair with the batch in which its text is scored: pairs in order of length, so that a batch needs little padding."""
    rows = f"(SELECT {PAIR}, length(ta) + length(tb) AS len, CAST(length(ta) + length(tb) AS BIGINT) AS part FROM @pair_text) x"
    return f"SELECT {PAIR}, CAST(len AS BIGINT) AS len, CAST(floor((rk - 1) / {C.batch}.0) AS BIGINT) AS batch FROM ({ranked(rows, '1', 'len, country, s1_num, src, b_num')}) y"


@relation()
def common_tokens(d: Dialect) -> str:
    """Report: the commonest tokens of each field, over all countries."""
    counts = "(SELECT field, tok, CAST(sum(df) AS BIGINT) AS n FROM @token_df GROUP BY field, tok)"
    one = lambda f: f"(SELECT field, tok, n FROM {counts} c WHERE field = '{f}' ORDER BY n DESC, tok LIMIT {C.report})"
    return f"SELECT * FROM {one('name')} x UNION ALL SELECT * FROM {one('addr')} y"


@relation()
def top_pairs(d: Dialect) -> str:
    """Report: the pairs of the highest score."""
    return f"SELECT {PAIR}, p FROM @predicted ORDER BY p DESC, country, s1_num, src, b_num LIMIT {C.report}"


LEARNED = tuple("learning_truth learn_addr_lexicon learn_name_alias name_map address_map mapped_records fixed_sample shuffled length_batches common_tokens top_pairs".split())
