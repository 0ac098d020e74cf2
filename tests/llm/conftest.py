import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"

#: Texts that every operator must take: null, empty, white space, copies, near copies, a very long one.
WORDS = [f"word{i}" for i in range(90)]
TEXTS = [
    None, "", " \t\n ", "a", "one two three four", " ".join(WORDS), " ".join(WORDS), " ".join(["other", *WORDS[1:]]), " ".join(WORDS[::-1]),
    "naïve Ünïcode ß " * 30, "line of ten words that is said once more today\n" * 3, "x" * 5000, " ".join(f"{w}-{i}" for i in range(300) for w in ("la", "mu")), "<|endoftext|> plain",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every awkward kind, with null ids, languages and sources, a repeated row, and extra
    columns whose names clash with those that operators make."""
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], len(t or ""), i, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here", "en", "a", 10, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, rejected_by string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    mine = sorted(str([r[c] for c in columns]) for r in df.collect())
    theirs = sorted(str([*r]) for r in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert mine == theirs
