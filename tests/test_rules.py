"""Rules on literal rows; what is expected follows from the rules' definition, not from the plan."""

import math
from collections import Counter

import pytest

from linkloom.config import LinkConfig
from linkloom.plans.workspace import Workspace


@pytest.fixture
def ws(spark):
    return Workspace(spark, "", config=LinkConfig(alias_count=2, keep_easy=2))


def pairs(spark, rows, columns):
    """Rows of one country, record 1..n against partner 1 of source 2."""
    return spark.createDataFrame([("us", k, 2, 1, *r) for k, r in enumerate(rows, 1)], f"country string, s1_num long, src long, b_num long, {columns}")


def test_mined_groups(spark, ws):
    rows = [(True, 0.89, False), (True, 0.9, False), (False, 0.02, False), (False, 0.019, True), (False, 0.019, False), (False, 0.5, True)]
    ws.give("alike", pairs(spark, rows, "y boolean, p double, near_alike boolean"))
    got = {(r.s1_num, r.g) for r in ws.relation("mine_groups").collect()}
    assert got == {(1, "hard_pos"), (2, "pos"), (3, "hard_neg"), (6, "hard_neg"), (4, "similar_neg"), (4, "rand_neg"), (5, "rand_neg")}
    assert {(r.s1_num, r.g) for r in ws.relation("dedupe_priority").collect()} == got - {(4, "rand_neg")}
    assert {(r.s1_num, r.g) for r in ws.relation("quota_sample").collect()} == got


def test_hard_negatives_go_by_token_sets(spark, ws):
    rows = [(False, 0.3, 0.0, 0.69, 0.71), (False, 0.3, 1.0, 0.69, 0.71), (False, 0.3, 1.0, 0.7, None), (True, 0.3, 0.0, 1.0, 1.0), (False, 0.3, 0.0, 0.1, 0.69)]
    every = pairs(spark, rows, "y boolean, p double, a_missing double, n_tset double, a_tset double")
    ws.give("predicted", every.drop("n_tset", "a_tset"))
    ws.give("pair_strings", every.drop("y", "p", "a_missing"))
    assert {r.s1_num for r in ws.relation("hard_negatives").collect()} == {1, 3}


def test_a_pair_without_neural_score_has_none(spark, ws):
    ws.give("left_join_scores", pairs(spark, [(None,), (0.0,), (0.5,)], "nn double"))
    got = {r.s1_num: (r.nn_p, r.nn_logit, r.nn_missing) for r in ws.relation("neural_columns").collect()}
    assert got == {1: (None, None, 1), 2: (0.0, round(math.log(1e-6 / (1 - 1e-6)), 6), 0), 3: (0.5, 0.0, 0)}


def test_typo_keys(spark, ws):
    tokens = [(1, "committee", 1), (1, "abc", 2), (2, "area51", 1), (2, "queue", 2), (3, "rarest", 1), (3, "second", 2), (3, "thirdly", 3), (4, "straße", 1), (5, "incorporatedly", 1)]
    ws.give("core_tokens", spark.createDataFrame([("us", 1, n, "name", t, rn) for n, t, rn in tokens], "country string, src long, num long, field string, tok string, rn int"))
    deletions = lambda t: {"d" + t} | {"d" + t[:k] + t[k + 1 :] for k in range(len(t))}
    got = {}
    for r in ws.relation("typo_keys").collect():
        got.setdefault(r.num, set()).add(r.key)
    assert got == {1: deletions("committee"), 2: deletions("queue"), 3: {"kscnd"} | deletions("rarest") | deletions("second")}  # cmt and rst are short


def test_selection_keeps_some_easy_pairs(spark, ws):
    rows = [(True, 0.99), (True, 0.97), (False, 0.01), (False, 0.02), (True, 0.5), (False, 0.51), (True, 0.01)]
    ws.give("predicted", pairs(spark, rows, "y boolean, p double"))
    got = Counter(r.s1_num for r in ws.relation("v3_selection").collect())
    easy = sorted((1, 2, 3, 4), key=lambda n: (n * 2654435761 + 40503 + 2) % 4294967296)[:2]
    assert got == Counter({5: 1, 6: 2, 7: 2, **dict.fromkeys(easy, 1)})


def test_learned_lexicon(spark, ws):
    """Weight of a replacement: nearness in place, against the pairs in which either token stands."""
    names = {(1, 1): "acme trading", (2, 1): "अक्मे trading", (1, 2): "acme foods", (2, 2): "अक्मे खाना"}
    places = [("in", s, n, k, t) for (s, n), name in names.items() for k, t in enumerate(name.split(), 1)]
    ws.give("truth", spark.createDataFrame([("in", n, 2, n) for n in (1, 2)], "country string, s1_num long, src long, b_num long"))
    ws.give("name_places", spark.createDataFrame(places, "country string, src long, num long, k long, tok string"))
    got = {r.tok: (r.repl, r.score) for r in ws.relation("learn_lexicon").collect()}
    assert got == {"अक्मे": ("acme", 1.0), "खाना": ("foods", 1.0)}


def test_learned_aliases(spark, ws):
    """Spelling variants, and synonyms that are rare in the reference and not of its hundred commonest; no chains."""
    extra = [(["srteet"], ["street"])] * 2 + [(["poona"], ["pune"])] * 2 + [(["bombay"], ["unit"])] * 2 + [(["once"], ["onde"])] + [(["abcd"], ["abce"])] * 2 + [(["abce"], ["abcd"])] * 2
    ws.give("missing_tokens", spark.createDataFrame([("in", k, 2, k, x, g) for k, (x, g) in enumerate(extra)], "country string, s1_num long, src long, b_num long, extra array<string>, gone array<string>"))
    df = [("street", 900, 1), ("unit", 800, 2), ("pune", 300, 101), ("poona", 2, 500), ("abcd", 1, 600), ("abce", 1, 601)]
    ws.give("reference_df", spark.createDataFrame([("in", t, n, rk) for t, n, rk in df], "country string, tok string, df long, rk int"))
    assert {(r.tok, r.repl) for r in ws.relation("learn_alias").collect()} == {("srteet", "street"), ("poona", "pune")}


def test_fixed_replacements_override_learned_ones(spark, ws):
    make = lambda rows, more="": spark.createDataFrame(rows, "country string, tok string, repl string" + more)
    ws.give("learn_alias", make([("in", "a", "b"), ("in", "c", "d")]))
    ws.give("fixed_tokens", make([("in", "a", "z")]))
    assert {(r.tok, r.repl) for r in ws.relation("token_map").collect()} == {("a", "z"), ("c", "d")}


def test_quota_through_ranges(spark, ws):
    """The lowest hashes of each group, over many ranges, as one ranking would take them."""
    rows = [("us" if k % 3 else "fr", k, 2, k % 7) for k in range(500)]
    ws.give("predicted", spark.createDataFrame(rows, "country string, s1_num long, src long, b_num long"))
    order = lambda r: ((r[1] * 2654435761 + r[3] * 40503 + r[2]) % 4294967296, *r[1:])
    expected = {r for c in ("us", "fr") for r in sorted((x for x in rows if x[0] == c), key=order)[: math.ceil(sum(x[0] == c for x in rows) / 10)]}
    assert {tuple(r) for r in ws.relation("proportional_quota").collect()} == expected
    each = {r for c in ("us", "fr") for r in sorted((x for x in rows if x[0] == c), key=lambda r: r[1:])[::8]}
    assert {tuple(r) for r in ws.relation("every_kth_row").collect()} == each
