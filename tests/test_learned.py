"""Learned maps, samples, orders, reports and reused countries on literal rows."""

import json

import pytest

from linkloom.config import LinkConfig
from linkloom.operators.link import Linker
from linkloom.operators.run import finished, write_missing
from linkloom.plans.workspace import Workspace
from linkloom.sources import reports

PAIR = "country string, s1_num long, src long, b_num long"


@pytest.fixture
def ws(spark):
    return Workspace(spark, "", config=LinkConfig(alias_count=2, learn_pairs=3, sample=4, batch=2, report=2))


def u(n):
    return (n * 2654435761) % 4294967296 / 4294967296


def order(r):
    return ((r[1] * 2654435761 + r[3] * 40503 + r[2]) % 4294967296, *r)


def test_maps_are_learned_from_no_held_out_record_and_few_pairs(spark, ws):
    rows = [(c, n, 2, n + 1) for c in ("in", "us") for n in range(1, 200)]
    ws.give("truth", spark.createDataFrame(rows, PAIR))
    held = {n for n in range(1, 200) if 0.7 * 0.15 <= u(n) < 0.15}
    assert held
    expected = {r for c in ("in", "us") for r in sorted((x for x in rows if x[0] == c and x[1] not in held), key=order)[:3]}
    assert {tuple(r) for r in ws.relation("learning_truth").collect()} == expected


def test_name_aliases_are_spelling_variants_only(spark, ws):
    extra = [(["pivate"], ["private"])] * 2 + [(["bombay"], ["mumbai"])] * 2 + [(["lndia"], ["india"])]
    ws.give("missing_name_tokens", spark.createDataFrame([("in", k, 2, k, x, g) for k, (x, g) in enumerate(extra)], PAIR + ", extra array<string>, gone array<string>"))
    assert {(r.tok, r.repl) for r in ws.relation("learn_name_alias").collect()} == {("pivate", "private")}


def test_later_maps_override(spark, ws):
    make = lambda *rows: spark.createDataFrame(list(rows), "country string, tok string, repl string")
    ws.give("learn_addr_lexicon", make(("in", "a", "1"), ("in", "b", "1"), ("in", "c", "1"), ("us", "a", "5")))
    ws.give("learn_alias", make(("in", "b", "2"), ("in", "c", "2")))
    ws.give("fixed_addr_tokens", make(("in", "c", "3")))
    assert {tuple(r) for r in ws.relation("address_map").collect()} == {("in", "a", "1"), ("in", "b", "2"), ("in", "c", "3"), ("us", "a", "5")}


def test_maps_applied_to_records(spark, ws):
    rows = [("in", 1, 1, "अक्मे pivate", "main raod", True), ("in", 2, 1, "अक्मे pivate अक्मे", "main raod", True), ("us", 3, 1, "pivate", "raod", False), ("us", 3, 2, "", "", False)]
    ws.give("records", spark.createDataFrame(rows, "country string, src long, num long, name_n string, addr_n string, name_nonlatin boolean"))
    ws.give("learn_lexicon", spark.createDataFrame([("अक्मे", "acmee")], "tok string, repl string"))
    ws.give("name_map", spark.createDataFrame([("in", "pivate", "private"), ("in", "acmee", "acme")], "country string, tok string, repl string"))
    ws.give("address_map", spark.createDataFrame([("in", "raod", "rd")], "country string, tok string, repl string"))
    got = {(r.country, r.src, r.num): (r.name_n, r.addr_n, r.name_nonlatin) for r in ws.relation("mapped_records").collect()}
    assert got == {
        ("in", 1, 1): ("अक्मे private", "main rd", True),  # source 1 gets no lexicon
        ("in", 2, 1): ("acme private acme", "main rd", True),
        ("us", 3, 1): ("pivate", "raod", False),
        ("us", 3, 2): ("", "", False),
    }


def test_learned_linker_blocks_on_mapped_records(spark):
    make = lambda k, rows: spark.createDataFrame([(f"S{k}-{n}", name, "1 main street", "in") for n, name in rows], "entity_id string, business_name string, business_address string, country string")
    s1 = make(1, [(n, f"{c}bakery private") for n, c in enumerate("cdfghjkm", 1)])
    s2 = make(2, [(n, f"{c}bakery pivate") for n, c in enumerate("cdfghjkm", 1)])
    truth = spark.createDataFrame([(n, 2, n) for n in range(1, 9)], "s1_num long, src long, b_num long")
    first = Linker(spark, s1, s2, make(3, []), truth, LinkConfig(alias_count=2))
    assert {(r.tok, r.repl) for r in first.relation("name_map").collect()} == {("pivate", "private")}
    names = {r.name_n for r in first.learned().relation("records").where("src = 2").collect()}
    assert names == {f"{c}bakery private" for c in "cdfghjkm"}


def test_samples_orders_and_reports(spark, ws):
    rows = [("us" if n % 2 else "fr", n, 2 + n % 2, n % 5, (n % 7) / 7) for n in range(1, 40)]
    ws.give("predicted", spark.createDataFrame(rows, PAIR + ", p double"))
    ordered = sorted((r[:4] for r in rows), key=order)
    assert {tuple(r)[:4] for r in ws.relation("fixed_sample").collect()} == set(ordered[:4])
    assert sorted((r.place, tuple(r)[:4]) for r in ws.relation("shuffled").collect()) == list(enumerate(ordered, 1))
    assert [tuple(r) for r in ws.relation("top_pairs").collect()] == sorted(rows, key=lambda r: (-r[4], r))[:2]
    ws.give("pair_text", spark.createDataFrame([("us", n, 2, 1, "x" * (n % 4), "é") for n in range(1, 8)], PAIR + ", ta string, tb string"))
    got = {r.s1_num: (r.len, r.batch) for r in ws.relation("length_batches").collect()}
    expected = {n: (n % 4 + 1, k // 2) for k, n in enumerate(sorted(range(1, 8), key=lambda n: (n % 4, n)))}
    assert got == expected


def test_empty_tables(spark, ws):
    ws.give("predicted", spark.createDataFrame([], PAIR + ", p double"))
    ws.give("truth", spark.createDataFrame([], PAIR))
    for name in ("fixed_sample", "shuffled", "top_pairs", "learning_truth"):
        assert ws.relation(name).isEmpty()


def test_json_maps_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("in", "a", 'say "b"', 0.1), (None, "c", "ü\nd", None)], "country string, tok string, repl string, score double")
    reports.write_json(rows, str(tmp_path / "j"))
    assert set(reports.read_json(spark, str(tmp_path / "j"), rows.schema).collect()) == set(rows.collect())
    reports.write_report(rows.where("score is not null"), str(tmp_path / "c"))
    assert reports.read_report(spark, str(tmp_path / "c"), rows.schema).collect() == rows.where("score is not null").collect()
    (tmp_path / "nested.json").write_text(json.dumps({"in": {"a": "b", "{x": "y"}, "us": {"c": "d"}}, indent=1))
    assert {tuple(r) for r in reports.read_map(spark, str(tmp_path / "nested.json")).collect()} == {("in", "a", "b"), ("in", "{x", "y"), ("us", "c", "d")}
    (tmp_path / "flat.json").write_text(json.dumps({"a": "b", "ß": "ss"}))
    assert {tuple(r) for r in reports.read_map(spark, str(tmp_path / "flat.json")).collect()} == {(None, "a", "b"), (None, "ß", "ss")}


def test_finished_countries_are_reused(spark, tmp_path):
    path = str(tmp_path / "step")
    make = lambda *rows: spark.createDataFrame(list(rows), "v long, country string")
    assert finished(spark, path) == []
    assert write_missing(make((1, "in"), (2, "a/b")), path) == []
    assert finished(spark, path) == ["a/b", "in"]
    assert write_missing(make((5, "in"), (6, "us"), (7, "a/b"), (8, None)), path, again=("a/b",)) == ["in"]
    assert {(r.v, r.country) for r in spark.read.parquet(path).collect()} == {(1, "in"), (6, "us"), (7, "a/b"), (8, None)}
