"""The two-stage ranking gives what the SQL gives, without a row for each pair of a group of equal texts."""

import duckdb
import pytest
from test_catalog import value
from test_tally import crowded, nodes  # noqa: F401

from lodestone.operators import ranking
from lodestone.plans import catalog, fixture


@pytest.mark.parametrize("name", ["w4_two_stage_ranking", "a15_recall_at_k"])
def test_equals_sql(spark, crowded, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(ranking, "HELD", 100)  # so that both sides have several parts
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{crowded[0]}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, crowded[0])
    columns = sorted(df.columns)
    mine = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    assert mine == sorted(tuple(map(value, r)) for r in con.sql(catalog.ORACLES[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_best_pairs_of_large_groups(spark, crowded):  # noqa: F811
    """The pairs kept are those of the full first stage, and no join lists a group's pairs."""
    records = fixture.records(spark, crowded[0])
    full = ranking.blocking.top_k(ranking.first_stage(records, 50), 20, "stage1", "s1")
    columns = ["s1", "cand", "cand_source", "stage1"]
    best = ranking.best_first(records, 50, 20).select(*columns)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, full.select(*columns).collect()))
    met = max(m.get().value() for p in nodes(best._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName() and (m := p.metrics().get("numOutputRows")).isDefined())
    assert 0 < met < full.count() * 8


def test_no_pair_is_dealt_anew_with_its_tokens(spark, crowded, monkeypatch):  # noqa: F811
    """Also with fewer parts than shuffle partitions, and without broadcasts."""
    plans, kept = [], ranking.files.kept

    def seen(df, name, **settings):
        made = kept(df, name, **settings)
        if name == "second-stage":
            for k, v in settings.items():
                spark.conf.set(k.replace("_", "."), v)
            plans.append(df.selectExpr("*")._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(ranking.files, "kept", seen)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ranking.rank(fixture.records(spark, crowded[0]), 50, 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plans and plans[0].count("REPARTITION_BY_NUM") == 3 and "ENSURE_REQUIREMENTS" not in plans[0]
