"""The corpus pipeline against its stages by brute force."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from linkloom.llm import langid, mixing, queries, simhash


def test_stages_and_run(spark, folder):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        after = [tuple(r) for r in out.collect()]
        if name != "pieces":
            assert out.columns == columns and set(after) <= set(before)
            docs = spark.createDataFrame(after, docs.schema)
        kept[name] = (before, after)
    model = langid.train(langid.labelled_sample(spark.read.parquet(f"{folder}/documents.parquet")))
    before, after = kept["language_id"]
    assert Counter(after) == Counter(r for r in before if not model.predict(r[1] or "")[2])
    before, after = kept["exact_dedup"]
    fold = lambda t: (t or "").encode().lower()
    last = {}
    for r in before:
        last[fold(r[1])] = max([x for x in (last.get(fold(r[1])), r[0]) if x is not None], default=None)
    assert Counter(after) == Counter(r for r in before if r[0] == last[fold(r[1])])
    before, after = kept["mixing"]
    assert sum(len((r[1] or "").split()) for r in after) >= 1.3 * sum(len((r[1] or "").split()) for r in before)
    assert set(Counter((r[0], r[1]) for r in after).values()) <= {1, 2, 4}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    expected = Counter((r[0], len(sp.encode(r[1] or "")), hashlib.sha256(",".join(map(str, sp.encode(r[1] or ""))).encode()).hexdigest()) for r in kept["mixing"][1])
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == expected


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixing_of_an_empty_table(empty):
    assert mixing.read_in_order(empty).columns == empty.columns


def test_near_copies_against_brute_force(spark):
    """Pairs of 0.8 Jaccard similarity on five words, most of them further apart than SimHash's 2 bits."""
    r = random.Random(5)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 200))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(r.randint(1, 4)):
                copy[r.randrange(len(copy))] = f"v{r.randrange(5000)}"
            texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    prints = [simhash.fingerprint(" ".join(t).encode()) for t in texts]
    beyond = 0
    for a in range(len(texts)):
        for b in range(a):
            close = (prints[a] ^ prints[b]).bit_count() <= 2
            similar = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            beyond += similar and not close
            if close or similar:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert beyond > 10
    docs = spark.createDataFrame([(k, " ".join(t), "en", "a", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(row[0] for row in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()) == sorted(set(group))


def test_one_row_of_each_group_of_near_copies(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(None, long, "en", "a", 1), (None, long + " x", "en", "a", 1), (1, "some other text of seven words here", "en", "a", 1)]
    rows += [rows[2], (7, "q " + long.replace("w", "u"), "en", "a", 1), (7, long.replace("w", "u"), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()]
    assert sorted(r[0] or 0 for r in got) == [0, 1, 7] and set(got) <= set(rows)
