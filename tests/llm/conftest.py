import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, content string, digest string, size string, bucket string, target string, hash string, spans string, h string, node string, key string, kept string, who string, `of` string, at string, `position` string"
EXTRA = ("x",) * 17


def words(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows and ties."""
    passage = words("p", 70)
    base = words("b", 90)
    rows = [
        (1, "Hello World", "en", "a"), (2, "hello world", "en", "b"), (3, "HELLO WORLD", None, None), (4, None, "en", "a"), (5, "", "de", "a"),
        (6, "é É straße", "de", None), (6, "é É straße", "de", None), (None, "hello world", "en", "a"), (None, None, None, None),
        (7, base, "en", "a"), (8, base + " tail", "en", "a"), (9, base.upper(), "fr", "c"), (10, words(10, 30) + " " + passage + " " + words(11, 5), "en", "b"),
        (11, passage + "\n" + words(12, 60), "en", "b"), (12, words(13, 9000), "fr", "c"), (13, "   \n\t ", "en", "a"), (14, "one two", "es", "b"), (15, "one  two", "es", "b"),
        (16, passage + " " + passage, "es", "a"), (17, " x▁y  z", "en", "d"), (17, "another text", "en", "d"), (18, "12 34 !!", "en", "d"),
    ]
    rows += [(100 + k, words(k, 20 + k), ("en", "de")[k % 2], "hot" if k % 3 else f"s{k}") for k in range(40)]
    rows += [(200 + k, "the same copy of a text", "en", "hot") for k in range(30)]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(tmp_path_factory, docs, spark):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)
