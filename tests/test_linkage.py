"""Literal rows, and the plan over a caller's own tables."""

import itertools
import math

import pytest

from linkloom.operators.link import Linker
from linkloom.plans import relations
from linkloom.plans.decisions import expected_f
from linkloom.plans.dialect import SPARK
from linkloom.plans.workspace import Workspace
from linkloom.sources import tsv

NAMES = {
    None: "", "M/S Foo Bar Pvt. Ltd.": "foo bar private limited", "M/S": "m s", "The Shri": "shri", "F0rd (ID: 43733)": "ford", "Acme.com & Sons": "acme and sons", "Dr. Mr. Lee": "lee",
    "O'Neil's Café": "oneils cafe", "shop.co.in": "shop", "x.comet": "xcomet", "": "", "  ": "", "Müller GmbH & Co.": "muller gmbh and company", "m s only": "only",
}
ADDRESSES = {
    None: "", "00211 Fifth St, Connecticut": "211 5 street court", "No 12 Nr Park": "12 near park", "NA 3rd Ave West Virginia": "3 avenue wv", "000": "0", "New York New York": "ny ny", "null": "", "21st N Main": "21 north main", "twenty 2eme": "twenty 2",
}


def test_literal_names_and_addresses(spark):
    from linkloom.functions import fold

    fold.register(spark)
    for cases, build in ((NAMES, relations.norm_name), (ADDRESSES, relations.norm_addr)):
        df = spark.createDataFrame(list(enumerate(cases)), "k long, x string")
        got = dict(df.selectExpr("k", f"{build(SPARK, 'x')} AS y").collect())
        assert {x: got[k] for k, x in enumerate(cases)} == cases


def sources(spark):
    make = lambda rows: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in tsv.COLUMNS))
    s1 = make([("S1-001", "Acme Trading Company", "12 Main St Springfield", "us"), ("S1-2", "Blue Ocean Fisheries", "7 Harbour Road Portland", "us"), ("S1-3", "Lonely Record", None, None), ("S1-4", None, None, "us")])
    s2 = make([("S2-10", "ACME Trading Co.", "12 Main Street, Springfield", "us"), ("S2-11", "Red Mountain Mining", "99 Hill Road", "us"), ("S2-12", "Acme Trading Company", "12 Main St", "fr")])
    s3 = make([("S3-20", "Blue Oceans Fisheries", "7 Harbour Rd Portland", "us"), ("S3-21", "Acme Tradng Company", "12 Main St Springfield", "us"), ("S3-22", None, None, None)])
    return s1, s2, s3


def test_linker(spark):
    truth = spark.createDataFrame([(1, 2, 10), (1, 3, 21), (2, 3, 20)], "s1_num long, src long, b_num long")
    link = Linker(spark, *sources(spark), truth)
    pairs = {(r.s1_num, r.src, r.b_num) for r in link.relation("candidates").collect()}
    assert {(1, 2, 10), (1, 3, 21), (2, 3, 20)} <= pairs and all(b != 12 for *_, b in pairs)
    result = {r.source1_entity_id: r.matched_entity_ids for r in link.result().collect()}
    assert set(result) == {"S1-1", "S1-2", "S1-3", "S1-4"} and result["S1-3"] == result["S1-4"] == ""
    owners = link.relation("one_owner").collect()
    assert len({(r.src, r.b_num) for r in owners}) == len(owners)
    assert link.relation("block_recall").first().recall == 1.0
    assert 0 <= link.relation("macro_f05").first().f05 <= 1


def test_linker_without_truth_or_rows(spark):
    nothing = spark.createDataFrame([], ", ".join(f"{c} string" for c in tsv.COLUMNS))
    link = Linker(spark, nothing, nothing, nothing)
    assert link.relation("candidates").collect() == [] and link.result().collect() == []


def test_tsv_files(spark, tmp_path):
    (tmp_path / "train_source1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""b"""\tNA\tus\nS1-2\t\tx\tnull\n')
    rows = tsv.read_source(spark, f"{tmp_path}/train_source1.tsv").collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'a "b"', None, "us"), ("S1-2", None, "x", None)]
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-5,S3-6\nS1-2\t\n")
    assert sorted(map(tuple, tsv.read_truth(spark, f"{tmp_path}/truth.tsv").collect())) == [(1, 2, 5), (1, 3, 6)]


@pytest.mark.parametrize("prior", [0.0, 0.2])
def test_expected_f_is_the_best_cut(spark, prior):
    import random

    r = random.Random(1)
    rows = [("us", e, 2, 10 * e + k, round(r.random(), 3)) for e in range(40) for k in range(r.randint(1, 6))]
    rows += [("us", 90, 2, 901, 0.9), ("us", 90, 2, 902, 0.6), ("us", 90, 2, 903, 0.2), ("us", 91, 2, 911, 0.1)]
    ws = Workspace(spark, "")
    ws.give("one_owner", spark.createDataFrame(rows, "country string, s1_num long, src long, b_num long, p double"))
    got = {}
    for x in ws.sql(expected_f(prior)).collect():
        got.setdefault(x.s1_num, set()).add(x.b_num)
    for e, group in itertools.groupby(rows, key=lambda x: x[1]):
        p = sorted(((x[4], -x[3]) for x in group), reverse=True)
        total = sum(x for x, _ in p) + prior
        f = [1.25 * sum(x for x, _ in p[: k + 1]) / (k + 1 + 0.25 * total) for k in range(len(p))]
        best = max(f)
        keep = next(k for k, x in enumerate(f) if x >= best - 1e-12) + 1 if math.prod(1 - x for x, _ in p) <= best else 0
        assert got.get(e, set()) == {-b for _, b in p[:keep]}
    if not prior:
        assert got[90] == {901} and 91 not in got


def test_run_and_configuration(spark, tmp_path):
    from linkloom.config import LinkConfig
    from linkloom.operators.run import run

    truth = spark.createDataFrame([(1, 2, 10)], "s1_num long, src long, b_num long")
    link = Linker(spark, *sources(spark), truth, LinkConfig(top_k=1, reverse_k=1, address_k=1))
    took = run(link.workspace, str(tmp_path))
    assert set(took) == {"records", "candidates", "pair_features", "predicted", "decide_threshold", "result_table"}
    assert spark.read.parquet(f"{tmp_path}/candidates").count() <= spark.read.parquet(f"{tmp_path}/records").count() ** 2
    missed = spark.createDataFrame([(4, 2, 11)], "s1_num long, src long, b_num long")
    with pytest.raises(RuntimeError):
        run(Linker(spark, *sources(spark), missed).workspace, str(tmp_path / "b"))
