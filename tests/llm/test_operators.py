"""Each operator against brute force, on rows with nulls, ties, repeats, long and empty texts and clashing columns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, langid, licenses, media, mixing, pieces, quality, queries, secrets, simhash, substring_dedup, webp
from linkloom.llm import words as words_model
from linkloom.llm.common import materialise

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(df, expected):
    """Rows as a multiset."""
    got = Counter(map(repr, (tuple(r) for r in df.collect())))
    assert got == Counter(map(repr, map(tuple, expected)))


def oracle(folder, sql):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    q = c.execute(sql)
    return [x[0] for x in q.description], q.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, folder, name):
    columns, expected = oracle(folder, queries.ORACLE_SQL[name])
    same(queries.QUERIES[name](spark, folder).select(*columns), expected)


def test_every_operator_takes_an_empty_table(empty):
    trained = langid.train(langid.labelled_sample(empty))
    for df in (
        exact_dedup.exact_dedup(empty), exact_dedup.keep_one(empty), secrets.scan_secrets(empty), media.media_features(empty), mixing.mix(empty), licenses.scan_licenses(empty),
        simhash.near_duplicates(empty), simhash.keep_one(empty), pieces.piece_digests(empty, queries.piece_model()), pieces.encode_pieces(empty, queries.piece_model()), mixing.read_in_order(empty), substring_dedup.dedup_substrings(empty), langid.identify(empty, trained), quality.classify(empty, empty.select("doc_id")),
    ):
        assert df.collect() == []


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    expected = []
    for i, t, *_ in rows:
        key = (t or "").translate(FOLD)
        keep = max((x for x in groups[key] if x is not None), default=None)
        expected.append((i, keep, len(groups[key]), i == keep, sha(key)))
    same(exact_dedup.exact_dedup(docs), expected)
    same(exact_dedup.exact_dedup(docs, trie_bytes=3000, salts=2), expected)  # subtrees are handed on in parts
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    same(kept.select("doc_id", "text"), [(r[0], r[1]) for r, e in zip(rows, expected, strict=True) if e[3]])


def test_patricia_trie_against_a_dict():
    import random

    r, trie, held = random.Random(3), exact_dedup.PatriciaTrie(), {}
    for k in range(3000):
        key = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12)))
        trie.insert(key, k, k, 1)
        low, high, n = held.get(key, (k, k, 0))
        held[key] = [low, k, n + 1]
    assert dict(trie.items()) == held
    got = dict(trie.spill())
    assert got and not set(got) & set(dict(trie.items())) and {**got, **dict(trie.items())} == held


def test_secret_spans(spark):
    key = "AKIA" + "Z9" * 8
    texts = [f'x é api_key = "abcdef1" y {key}é', "PASSWORD:short", "secret=token: abcdefg", "token:secret=ab", "0" * 30 + " " + "a" * 23, f"token={'f' * 24}", None, ""]
    kinds = [re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    df = spark.createDataFrame([(k, t, "o") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secrets.scan_secrets(df).collect():
        t = texts[r.doc_id] or ""
        found = [(m.start(), 0, m.end()) for m in kinds[0].finditer(t) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in kinds[1].finditer(t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in kinds[2].finditer(t) if len(m[0]) >= 24]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r.base_sha256 == sha(base) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_places_of_many_secrets_in_one_text(spark):
    """Several blocks of matches; twice the matches take about twice the time."""
    import time

    took = []
    for n in (1, 8000, 16000):
        parts = [f"é{k:024x}" for k in range(n)]
        text = " ".join(parts)
        df = spark.createDataFrame([(1, text, "o")], "doc_id long, text string, source string")
        t = time.perf_counter()
        (r,) = secrets.scan_secrets(df).collect()
        took.append(time.perf_counter() - t)
        assert r.n_hex == n and r.base_sha256 == sha(",".join(f"hex:{26 * k + 1}:{26 * k + 25}" for k in range(n)))
    assert took[2] < 2.5 * took[1] + 2


def test_secrets_of_many_owners_are_examples(spark):
    text = "token = abcdefgh12"
    df = spark.createDataFrame([(k, text, f"o{k}") for k in range(2)] + [(9, "token = only4one", "o1")], "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(df).collect()}
    assert got == {0: "assign:0:18,example:8:18", 1: "assign:0:18,example:8:18", 9: "assign:0:16,live:8:16"}


def test_webp_features(docs, rows):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_features(docs).collect())
    expected = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes(64 if not b else -len(b) % 64)
        expected[i, len(b), len(p), sha(p), zlib.crc32(p[-64:])] += 1
    assert got == expected


@pytest.mark.parametrize("payload", [b"", b"a", bytes(range(256)) * 3, "жзий".encode() * 99, b"x" * (64 * 16384 + 5)])
def test_stored_payload_round_trip(payload):
    p = media.padded(payload)
    assert len(p) % 64 == 0 and p and media.load(media.store(p)).tobytes() == p


@pytest.mark.parametrize("predictor", [None, 0, 2, 5, 11, 12, 13, 15])
@pytest.mark.parametrize("cross", [None, 0x00F37A15])
def test_webp_round_trip(predictor, cross):
    rng = np.random.default_rng(1)
    noise = lambda *s: rng.integers(0, 2**32, s, dtype=np.uint64).astype(np.uint32)
    images = [noise(9, 13), np.zeros((1, 1), np.uint32), rng.integers(0, 3, (20, 17)).astype(np.uint32) * 0x01020304, np.tile(noise(4, 16), (6, 1)), rng.integers(0, 2, (7, 30)).astype(np.uint32)]
    for image in images:
        for palette in (False, True):
            for options in ({}, {"level": True}, {"search": True}, {"cache_bits": 4}, {"search": True, "cache_bits": 10, "green": True}):
                data = webp.encode(image, palette=palette, predictor=predictor, cross=cross, **options)
                assert np.array_equal(webp.decode(data), image)


def test_webp_rejects_cut_streams():
    data = webp.encode(np.arange(600, dtype=np.uint32).reshape(20, 30))
    for n in (10, 30, len(data) - 40):
        with pytest.raises(ValueError):
            webp.decode(data[:n])


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, count(t)) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += count(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, openly = {}, 1.5 * sum(sizes.values()), set(order)
    while True:  # share, stop those above, share again
        level = left / sum(weight[s] for s in openly)
        over = {s for s in openly if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        openly -= over
    target |= {s: level * weight[s] for s in openly}
    taken, seen = defaultdict(int), {}
    by_id = {i: s for i, _, _, s, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            assert math.isclose(r.target, target[by_id[r.doc_id]], abs_tol=1e-5) and r.source_size == sizes[by_id[r.doc_id]]
        taken[r.source_size, r.target] += r.taken
        seen[r.source_size, r.target] = r.target
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places)
    assert Counter(map(repr, got)) == Counter(map(repr, mixing.mix(docs.repartition(7), digits=1).collect()))


@pytest.mark.parametrize("knots", mixing.SCHEDULES + (((0.0, 0.0), (0.3, 2.0), (1.0, 0.5)),))
def test_schedules_invert(spark, knots):
    from pyspark.sql import functions as F

    for share, t in spark.range(0, 101).select((F.col("id") / 100).alias("y")).select("y", mixing.invert_schedule(F.col("y"), knots)).collect():
        total = done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            total += (w0 + w1) / 2 * (t1 - t0)
            x = min(max(t, t0), t1)
            done += (w0 + w0 + (w1 - w0) * (x - t0) / (t1 - t0)) / 2 * (x - t0)
        assert done / total == pytest.approx(share, abs=1e-9)


def test_licenses(spark):
    notice = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    texts = ["MIT License, mit\nlicense MIT Licenses", "GNU General Public License v3", "no words here", None, "", "x " * 50 + notice, "licence " + " ".join(notice.split()[:30]) + " some new words " + " ".join(notice.split()[30:]), "mitÉ license apache license"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        at = [k for k in range(len(w)) if w[k : k + 2] in (["mit", "license"], ["apache", "license"]) or w[k : k + 3] == ["general", "public", "license"]]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[0].base_labels == "mit" and got[1].base_labels == "gpl" and got[5].labels == got[6].labels == "bsd" and got[5].score == 1.0 and got[2].labels == ""


def test_matching_statistics_against_brute_force():
    import random

    r = random.Random(5)
    seqs = [[r.randint(0, 3) for _ in range(r.randint(5, 25))] for _ in range(4)]
    auto = licenses.Automaton(seqs)
    text = [r.randint(0, 4) for _ in range(400)]
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for k, (n, state) in enumerate(auto.statistics(text)):
        assert n == max((m for m in range(1, k + 2) if tuple(text[k + 1 - m : k + 1]) in runs), default=0)
        if n:
            run = text[k + 1 - n : k + 1]
            assert {(w, e) for w, ends in auto.ends[state].items() for e in ends} == {(w, e) for w, s in enumerate(seqs) for e in range(len(s)) if e + 1 >= n and s[e + 1 - n : e + 1] == run}


def prints(rows):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


def test_simhash(docs, rows):
    fps = prints(rows)
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((fps[k][0] for k in range(len(fps)) if group[k] == g and fps[k][0] is not None), default=None) for g in set(group)}
    expected = [(i, f"{f:016x}", least[group[k]]) for k, (i, f) in enumerate(fps)]
    same(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"), expected)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    same(kept.select("doc_id"), [(i,) for i, _, c in expected if i == c])


def test_anchors_meet_every_pair_and_components_chain(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 150, dtype=np.uint64)
    flips = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in r.integers(0, 64, (3, 2))]
    chain = [sum(1 << k for k in range(n)) for n in range(0, 60, 2)]  # each two bits from the next
    values = sorted({int(x) - (int(x) >> 63 << 64) for x in [*base.tolist(), *flips, *chain]})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    u = np.array(values, np.int64).view(np.uint64)
    expected = {(values[a], values[b]) for a in range(len(u)) for b in np.flatnonzero(np.bitwise_count(u ^ u[a]) <= 2).tolist() if a < b}
    pairs = simhash.links(df)
    assert {tuple(x) for x in pairs.collect()} == expected
    roots = dict(map(tuple, simhash.components(pairs).collect()))
    ends = [c - (c >> 63 << 64) for c in chain]
    assert len({roots[c] for c in ends}) == 1 and all(roots[a] == roots[b] for a, b in expected) and all(v <= k for k, v in roots.items())


def test_simhash_does_not_broadcast_what_python_multiplies(spark):
    prints = materialise(spark.range(400).select(F.xxhash64("id").alias("fp")), "test-prints").coalesce(1)
    assert int(str(prints._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10 << 20  # by Spark's estimate, small
    pairs = simhash.links(prints)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert pairs.count() == 0


def test_pieces(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    expected = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    same(pieces.piece_digests(docs, queries.piece_model()), expected)
    same(pieces.piece_digests(docs, queries.piece_model(), most_chunks=3), expected)
    assert all(r.ids == sp.encode(t or "") for r, (_, t, *_) in zip(sorted(pieces.encode_pieces(docs.where("doc_id >= 100"), queries.piece_model()).collect()), [x for x in rows if x[0] and x[0] >= 100], strict=True))


def test_pieces_of_odd_texts():
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    with open(queries.piece_model(), "rb") as f:
        table = pieces.chunk_table(f.read())
    r = random.Random(1)
    alphabet = [" ", "  ", "\n", "\r", "\t", "▁", "a", "the", "é", "ß", "日", "𝄞", "<s>", "</s>", "<0x41>", " ", "\x00", ";", "}", "​", "ﬁ", "é"]
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))
        ids = sp.encode(text)
        assert table.encode(text) == (",".join(map(str, ids)), sp.decode(ids)), repr(text)


def brute_windows(rows, size=50):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        yield i, len(w), len(w) - len(kept), sha(b" ".join(kept))


def test_substring_dedup(docs, rows):
    expected = list(brute_windows(rows))
    assert sum(e[2] for e in expected) > 100
    same(substring_dedup.dedup_substrings(docs), expected)
    same(substring_dedup.dedup_substrings(docs, bits=8), expected)  # a full bitmap tells nothing apart and changes nothing
    same(substring_dedup.dedup_substrings(docs, seed_words=10, hot_share=0.001), expected)  # the groups of salted minimisers meet again
    same(substring_dedup.dedup_substrings(docs, seed_words=50, hot_share=0.01), expected)
    same(substring_dedup.dedup_substrings(docs, window=3, seed_words=3), list(brute_windows(rows, 3)))


def test_language_id(spark, docs, rows):
    sample = langid.labelled_sample(docs)
    assert Counter(sample) == Counter((t or "", lang) for i, t, lang, *_ in rows if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    got = langid.identify(docs, langid.train(sample)).collect()
    labels = {lang for _, lang in sample}
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if len(texts[r.doc_id]) == 1:
            (t,) = texts[r.doc_id]
            assert r.lang_pred in labels if any(c.isalpha() for c in t or "") else r.lang_pred == "und"
    assert all(r.lang_pred == "und" for r in langid.identify(docs, langid.train([])).collect())


def test_the_labelled_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(0, "x" * 50, "en")] * 300 + [(k, "y" * k, "de") for k in range(1, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.labelled_sample(df, most=7)) == 7
    few = langid.labelled_sample(df, most_bytes=500)
    assert 0 < sum(len(t) for t, _ in few) <= 500
    assert few == langid.labelled_sample(df.repartition(5), most_bytes=500)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_language_id_on_documents_that_it_has_not_seen(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op10_langid(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.lang_pred != "und" and langs[r.doc_id] is not None]
    assert len(held) > 200 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_id_learns():
    words = {"xx": "aba bab abba baab", "yy": "cdc dcd cddc dccd", "zz": "efe fef effe feef"}
    import random

    r = random.Random(4)
    make = lambda y: " ".join(r.choice(words[y].split()) for _ in range(r.randint(3, 30)))
    model = langid.train([(make(y), y) for _ in range(40) for y in words])
    assert sum(model.predict(make(y))[0] == y for _ in range(30) for y in words) == 90
    long = "aba " * 200_000  # several spans
    assert model.predict(long)[0] == "xx"


def test_quality(spark, folder, docs, rows):
    trusted = [t.encode() for i, t, *_ in rows if i is not None and 100 <= i < 130]
    n = np.zeros(quality.CODES, np.int64)
    for t in trusted:
        c = [29, 29, *quality.CLASS_OF[np.frombuffer(t, np.uint8)].tolist()]
        for a, b, x in zip(c, c[1:], c[2:]):
            n[a << 12 | b << 6 | x] += 1
    cube = n.reshape(64, 64, 64)
    kinds = (cube > 0).sum(0)
    high = quality.discounts([(n == k).sum() for k in (1, 2, 3, 4)])
    low = quality.discounts([(kinds == k).sum() for k in (1, 2, 3, 4)])
    one = (kinds > 0).sum(0)

    def p(a, b, c):
        take = lambda k, d: 0 if not k else d[min(int(k), 3) - 1]
        p1 = max(one[c] - 0.5, 0) / one.sum() + np.minimum(one, 0.5).sum() / one.sum() / 64
        t2, t3 = kinds[b].sum(), cube[a, b].sum()
        p2 = (max(kinds[b, c] - take(kinds[b, c], low), 0) / t2 + sum(take(k, low) for k in kinds[b]) / t2 * p1) if t2 else p1
        return (max(cube[a, b, c] - take(cube[a, b, c], high), 0) / t3 + sum(take(k, high) for k in cube[a, b]) / t3 * p2) if t3 else p2

    got = queries.op1_quality(spark, folder).collect()
    assert len(got) == len(rows)
    for i, t in [(r[0], r[1]) for r in rows if r[0] in (1, 6, 14, 18, 105, 135)]:
        c = [29, 29, *quality.CLASS_OF[np.frombuffer(t.encode(), np.uint8)].tolist()]
        logs = [math.log(max(p(a, b, x), 1e-12)) for a, b, x in zip(c, c[1:], c[2:])]
        assert all(r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6) for r in got if r.doc_id == i)
    assert all(r.perplexity is None and not r.kept for r in got if r.doc_id in (4, 5)) and all(r.kept for r in got if r.doc_id is not None and 100 <= r.doc_id < 130)
    total = sum(p(3, 4, c) for c in range(64))
    assert total == pytest.approx(1, abs=1e-9)
    nothing = quality.classify(docs, docs.select("doc_id").limit(0)).collect()
    assert all(r.kept == (r.perplexity is not None) for r in nothing)


def test_quality_thresholds(spark, folder, rows):
    """A language's threshold is a quantile of its trusted documents, for words of those not counted; kept needs both."""
    got = queries.op1_quality(spark, folder).collect()
    content = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    back = {i for i, t, *_ in rows if i is not None and 100 <= i < 130 and (content(t) - (content(t) >> 63 << 64)) % words_model.HELD_BACK == 0}
    good = [r for r in got if r.doc_id is not None and 100 <= r.doc_id < 130]

    def cut(values):
        values = sorted(values)
        return values[math.ceil(0.995 * len(values)) - 1] * 1.03 if values else None

    own = {lang: cut([r.perplexity for r in good if r.lang == lang]) for lang in ("en", "de")}
    own_words = {lang: cut([r.word_perplexity for r in good if r.lang == lang and r.doc_id in back]) for lang in ("en", "de")}
    whole, whole_words = cut([r.perplexity for r in good]), cut([r.word_perplexity for r in good if r.doc_id in back])
    assert back and all(own.values())
    for r in got:
        t, w = own.get(r.lang) or whole, own_words.get(r.lang) or whole_words
        assert (r.threshold, r.word_threshold) == (pytest.approx(t), pytest.approx(w))
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.threshold and (r.word_perplexity is None or r.word_perplexity <= r.word_threshold))
    assert {r.kept for r in got} == {True, False}


def test_packed_vectors_round_trip():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, quality.CODES, 500)).astype(np.uint32)
    counts = rng.integers(1, 100_000, len(codes))
    a, b = quality.unpack(quality.pack(codes, counts))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(codes.tolist(), counts.tolist(), strict=True))


def test_quality_by_words(spark, folder, rows):
    """Perplexities by an open vocabulary against brute force; the model grows with the trusted text."""
    content = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    content_signed = lambda t: content(t) - (content(t) >> 63 << 64)
    counted = [t for i, t, *_ in rows if i is not None and 100 <= i < 130 and content_signed(t) % words_model.HELD_BACK]
    assert 0 < len(counted) < 30
    pad = lambda t: ["<s>", "<s>", *t.split(), "</s>"]
    tri = Counter(g for t in counted for g in zip(pad(t), pad(t)[1:], pad(t)[2:]))
    two = Counter((b, c) for _, b, c in tri)
    one = Counter(c for _, c in two)
    d3, d2 = (quality.discounts([sum(v == k for v in n.values()) for k in (1, 2, 3, 4)]) for n in (tri, two))
    by3, by2 = defaultdict(list), defaultdict(list)
    for (a, b, _), n in tri.items():
        by3[a, b].append(n)
    for (b, _), n in two.items():
        by2[b].append(n)
    total = sum(one.values())

    def mix(n, context, d, under):
        return under if not context else (n - d[min(n, 3) - 1] if n else 0) / sum(context) + sum(d[min(k, 3) - 1] for k in context) / sum(context) * under

    def p(a, b, c):
        p1 = max(one[c] - 0.5, 0) / total + 0.5 * len(one) / total / (len(one) + 1)
        return mix(tri[a, b, c], by3.get((a, b)), d3, mix(two[b, c], by2.get(b), d2, p1))

    some = pad(counted[0])
    for a, b in ((some[2], some[3]), ("<s>", "<s>"), ("nowhere", some[3]), ("no", "where")):
        assert sum(p(a, b, c) for c in [*one, "unknown"]) == pytest.approx(1)
    got = queries.op1_quality(spark, folder).collect()
    for i, t, *_ in rows:
        if t and i is not None and [r[0] for r in rows].count(i) == 1:
            logs = [math.log(p(*g)) for g in zip(pad(t), pad(t)[1:], pad(t)[2:])]
            assert [r.word_perplexity for r in got if r.doc_id == i] == [pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6)]
    sizes = [words_model.word_model(spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)),)], "text string"))[0].count() for n in (1000, 10_000)]
    assert sizes[1] > 9 * sizes[0]


def test_a_line_repeated_within_a_few_documents_is_salted(spark):
    """Runs of one minimiser are dealt over many groups, whether many documents or one hold them."""
    from pyspark.sql import functions as F

    line = " ".join(f"l{k}" for k in range(35))
    rows = [(k, " ".join([line] * 400)) for k in range(3)] + [(3, "w " * 3000), (4, "z " + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    source = substring_dedup._source(docs, "doc_id", "text")
    seeds = substring_dedup.shared_seeds(source, 50, 30)
    assert max(r.n for r in seeds.collect()) > 1000
    marks = spark.sparkContext.broadcast((substring_dedup.bitmap(seeds, 16), *substring_dedup.hot_seeds(seeds, 0.02)))
    sizes = [r.n for r in substring_dedup._runs(source, marks, 50, 30, 16).groupBy("seed", "salt").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) > 1000 and max(sizes) < 50
    same(substring_dedup.dedup_substrings(docs, hot_share=0.02), list(brute_windows([(i, t, None) for i, t in rows])))


def test_media_stores_copies_and_a_transform():
    r = np.random.default_rng(3)
    noise = r.integers(0, 256, 5000, np.uint8).tobytes()
    text = b"the quick brown fox jumps over a lazy dog, and again "
    for body in (b"", b"a", bytes(64), b"ab" * 3000, b"x" * 9000, noise, noise + noise[100:4000], text * 40, b"\n".join(text[k:] + text[:k] for k in range(50)), text * 25_000, noise[:3] + b"\xff" * 70):
        payload = media.padded(body)
        stored = media.store(payload)
        assert media.load(stored).tobytes() == payload
        assert stored[25] & 1 and stored[25] >> 1 & 3 == webp.SUBTRACT_GREEN
        if len(body) > 2000 and body != noise:
            assert len(stored) < len(body) * (0.7 if body.startswith(noise) else 0.2)


def test_words_are_scored_in_rounds_that_hold_a_part_of_the_triples(spark, docs):
    """Each triple of the documents goes to one shard of one round; what a round shuffles is gone when it ends."""
    from pyspark.sql import functions as F

    source = docs.select(F.xxhash64("doc_id", "text").alias("ident"), F.coalesce("text", F.lit("")).alias("text"))
    texts = [r.text for r in source.collect()]
    deal = words_model._dealer(source.select("text"))
    sizes, found = [], set()
    for r in range(words_model.ROUNDS):
        n = 0
        for row in words_model._sent_docs(source, deal, words_model.ROUNDS, r).where(F.col("kind") == words_model.DOC_TRIPLES).collect():
            assert row.shard % words_model.ROUNDS == r
            a, b, c = words_model.unpack(row.packed[4 + 12 * int.from_bytes(row.packed[:4], "little") :], 3)[0]
            found.update(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))
            n += len(a)
        sizes.append(n)
    pad = lambda t: ["<s>", "<s>", *t.encode().split(), "</s>"]
    every = [g for t in texts if t for g in zip(pad(t), pad(t)[1:], pad(t)[2:])]
    assert sum(sizes) == len(every) and max(sizes) < 0.3 * len(every) and len(found) == len(set(every))


def test_frequent_middle_words_are_dealt_over_shards(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    source = docs.select(F.xxhash64("doc_id", "text").alias("ident"), F.coalesce("text", F.lit("")).alias("text"))
    trusted = source.where("length(text) < 400").select("text")
    scores = lambda: {r.ident: r.word_perplexity for r in words_model.word_perplexities(source, trusted).collect()}
    whole = scores()
    monkeypatch.setattr(words_model, "HOT_TRIPLES", 8)
    deal = words_model._dealer(trusted)
    assert len(deal.hot) > 2 and deal.parts.max() > 3
    assert len(whole) > 50 and scores() == {k: pytest.approx(v, rel=1e-9) for k, v in whole.items()}


def test_a_round_reads_trusted_documents_once_and_classes_need_no_shuffle(spark, docs):
    """Documents that are trusted send what the trusted texts would have sent; the class model is scored where texts are read."""
    from pyspark.sql import functions as F

    source = docs.select(F.xxhash64("doc_id", "text").alias("ident"), F.coalesce("text", F.lit("")).alias("text"), (F.length("text") % 3 == 0).alias("counted"))
    trusted = source.where("counted").select("text")
    deal = words_model._dealer(trusted)

    def triples(rows):
        out = Counter()
        for row in rows.where(F.col("kind") == words_model.TRUSTED).collect():
            columns, (n,) = words_model.unpack(row.packed, 3)
            for *g, k in zip(*(c.tolist() for c in columns), n.tolist(), strict=True):
                out[row.shard, *g] += k
        return out

    for r in range(words_model.ROUNDS):
        want = triples(words_model._sent_triples(trusted, deal, words_model.ROUNDS, r))
        assert want and triples(words_model._sent_docs(source, deal, words_model.ROUNDS, r)) == want
    scores = lambda d: {r.ident: r.word_perplexity for r in words_model.word_perplexities(d, trusted).collect()}
    assert words_model.ROUNDS < words_model.ROUNDS_APART
    assert scores(source) == {k: pytest.approx(v, rel=1e-9) for k, v in scores(source.drop("counted")).items()}
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    scored = plan(quality.perplexities(source.select("ident", "text"), quality._counted(trusted)))
    assert "MapInArrow" in scored and scored.count("Exchange") == plan(source).count("Exchange")


def test_words_of_all_lengths_have_hashes_of_their_own():
    letters = "aäb"
    told = [("x" * n + c + "y" * m).encode() for n in (0, 1, 6, 7, 8, 9, 15, 16, 255, 256, 257, 1000) for m in (0, 1, 300) for c in letters]
    told = sorted(set(told))
    hashes, first = words_model.Words().hashes(b" \n".join(told) + b"\t")
    assert len(set(hashes.tolist())) == len(told) and first[1] == len(told[0]) + 2
    again = words_model.Words().hashes(b"\r\x0b".join(told[::-1]))[0]
    assert again.tolist() == hashes.tolist()[::-1] and max(hashes.tolist()) < 1 << words_model.WORD_BITS
    assert [len(words_model.Words().hashes(t)[0]) for t in (b"", b" ", b"\n\t", b"a")] == [0, 0, 0, 1]


def test_webp_bits_copies_and_runs_of_literals_against_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 5000):
        sizes = r.integers(0, 19, n)
        values = r.integers(0, 1 << 18, n) & (1 << sizes) - 1
        w = webp.BitWriter()
        w.write(5, 3)
        w.extend(values, sizes)
        bits = "101" + "".join(f"{v:0{k}b}"[::-1] for v, k in zip(values.tolist(), sizes.tolist(), strict=True) if k)
        bits += "0" * (-len(bits) % 8)
        assert w.bytes() == bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    for body in (b"", b"1234567", b"12345678" * 2, b"ab" * 300, bytes(r.integers(0, 3, 3000, np.uint8)), bytes(r.integers(0, 256, 900, np.uint8)) * 2):
        last, at, want = {}, 0, []
        back = [0] * max(0, len(body) - webp.MATCH + 1)
        for k in range(len(back)):
            key = body[k : k + webp.MATCH]
            back[k] = k - last.get(key, k)
            last[key] = k
        k = 0
        while k < len(back):
            j = k
            while j < len(back) and back[j] == back[k]:
                j += 1
            s, e = max(k, at), j + webp.MATCH - 1
            if back[k]:
                while e - s >= webp.MATCH:
                    want.append([s, min(e - s, 4096), back[k]])
                    s += want[-1][1]
                at = s
            k = j
        assert webp._matches(np.frombuffer(body, np.uint8)).tolist() == want
    code = webp._code_of(media.usual_code()[0])
    for body in [b"some plain text, told once; " * 2 + bytes(r.integers(97, 123, n, np.uint8)) for n in range(0, 600, 20)]:
        payload = media.padded(body)
        assert media.load(media.store(payload)).tobytes() == payload
    runs = code.runs()
    assert max(len(x) for x, _ in runs) > 1 and all(k <= code.bits for _, k in runs)
    with pytest.raises(ValueError):
        media.load(media.store(payload)[:-40] + bytes(0))
