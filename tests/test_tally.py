"""Queries that count pairs give what the SQL gives, without a row for each pair of a large group."""

import duckdb
import pytest
from test_catalog import value

from lodestone.operators import tally
from lodestone.plans import catalog

COUNTING = ["a10_pair_statistics", "a13_blocking_recall", "a14_candidate_counts", "a20_class_balance", "a8_local_weights", "a16_pair_metrics", "a17_entity_macro", "a18_official_metric", "a19_best_threshold", "a19_entity_sweep", "a19_pair_sweep", "a21_feature_summary"]


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return nodes(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return nodes(plan.plan())
    below = plan.children()
    return [plan] + [x for k in range(below.size()) for x in nodes(below.apply(k))]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """900 documents that begin alike, some of them copies, also in another language or with another
    beginning, and empty and short ones."""
    rows = []
    for i in range(900):
        words = ["common", "start", "of", "six", "words", "here"] + [f"w{i * k % 97}" for k in range(1, 3 + i % 30)] + [f"n{i % 11} {i}"] * (i % 7 > 0)
        rows.append((i, " ".join(words), ["en", "de"][i % 5 == 0]))
    rows += [(1000 + i, "other first six words are these " + rows[7 * (i // 9)][1].split(" ", 6)[-1], "en") for i in range(60)]
    rows += [(2000 + i, [None, "", "one", "one two"][i % 4], [None, "en"][i % 3 == 0]) for i in range(40)]
    path = str(tmp_path_factory.mktemp("crowded"))
    spark.createDataFrame([(*r, "web", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path, len(rows)


@pytest.mark.parametrize("name", COUNTING)
def test_equals_sql_without_listing_pairs(spark, crowded, monkeypatch, name):
    monkeypatch.setattr(tally, "BLOCK", 100)  # so that a name has several blocks
    path, n = crowded
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    mine = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    assert mine == sorted(tuple(map(value, r)) for r in con.sql(catalog.ORACLES[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())
    met = [m.get().value() for p in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName() and (m := p.metrics().get("numOutputRows")).isDefined()]
    assert met and max(met) < 20 * n, max(met)
