"""Features of listed pairs are what the SQL or the pairs' own texts give, and no pair is shuffled."""

import duckdb
import pytest
from test_catalog import value
from test_tally import crowded, nodes  # noqa: F401

from lodestone.functions import similarity as sim
from lodestone.functions import text
from lodestone.operators import blocking, features, tally
from lodestone.plans import catalog, fixture


@pytest.mark.parametrize("name", ["a9_addr_weighted_overlap", "g_serve_token_features", "u_digit_similarity"])
def test_equal_without_a_shuffle_of_pairs(spark, crowded, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(tally, "BLOCK", 50)  # so that a name has several parts
    path, n = crowded
    df = catalog.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    mine = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLES:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        want = con.sql(catalog.ORACLES[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    else:
        r = fixture.records(spark, path)
        texts = blocking.with_text(fixture.pairs(r), r)
        want = texts.select("s1", "cand", sim.indel_ratio_empty(text.digits_only("s1_addr"), text.digits_only("c_addr")).alias("digit_similarity")).select(*columns).collect()
    assert mine == sorted(tuple(map(value, r)) for r in want)
    written = [m.get().value() for p in nodes(df._jdf.queryExecution().executedPlan()) if "Exchange" in p.nodeName() and (m := p.metrics().get("shuffleRecordsWritten")).isDefined()]
    assert max(written, default=0) < 50 * n < len(mine), max(written, default=0)


def test_all_features_of_paired_records(spark):
    r, keys = fixture.records(spark, "/root/testdata/sf0.001"), ["s1", "cand", "cand_source"]
    made, want = (sorted(map(tuple, features.features(p, keys, r).collect())) for p in (fixture.paired(r), fixture.pairs(r)))
    assert repr(made) == repr(want) and len(made) > 100


@pytest.mark.parametrize("name", ["g_serve_token_features", "a9_addr_weighted_overlap", "g_serve_features", "g_legacy_features"])
def test_pairs_of_equal_names_are_measured_in_blocks(spark, crowded, name):  # noqa: F811
    path, n = crowded
    df = catalog.QUERIES[name](spark, path)
    assert len(df.collect()) > 100 * n
    met = [m.get().value() for p in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName() and (m := p.metrics().get("numOutputRows")).isDefined()]
    assert met and max(met) < 50 * n, max(met)  # no join makes a row for each pair
