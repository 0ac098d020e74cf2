"""Blocking, metrics, output, validation, models and files on small tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocking, metrics, model, output, pairs, ranking, stats, validate
from lodestone.sources import files

RECORDS = [
    ("S1-1", 1, "acme corp", "12 road", "us"), ("S1-2", 1, "zeta", "", ""), ("S1-3", 1, "", "9 lane", "in"),
    ("S2-1", 2, "acme corp", "13 street", "us"), ("S2-2", 2, "acme", "12 road", "fr"), ("S3-1", 3, "zeta gmbh", "", "de"), ("S3-2", 3, "", "9 lane", "in"), ("S3-3", 3, "", "", "us"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "entity_id string, source int, name string, addr string, country string")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_exact_skips_empty(records):
    assert rows(blocking.exact(records, "name")) == [("S1-1", "S2-1", 2)]
    assert rows(blocking.exact_any(records)) == [("S1-1", "S2-1", 2), ("S1-1", "S2-2", 2), ("S1-3", "S3-2", 3)]


@pytest.mark.parametrize("policy, found", [("strict", {"S2-1", "S3-2"}), ("left_wildcard", {"S2-1", "S3-1", "S3-2"}), ("wildcard", {"S2-1", "S3-1", "S3-2"})])
def test_country_policies(records, policy, found):
    assert {r["cand"] for r in blocking.token_pairs(records, 100, policy).collect()} == found


def test_cap_and_top_k(records):
    assert rows(blocking.token_pairs(records, 0)) == []
    top = blocking.top_k(blocking.shared_counts(records, 100), 1, "n_shared", "s1", "cand_source")
    assert rows(top, "s1", "cand", "n_shared") == [("S1-1", "S2-1", 2), ("S1-2", "S3-1", 1)]


def test_rarest_tokens_come_in_order(records):
    best = rows(blocking.rarest_tokens(records, 100, 2), "s1", "token", "freq", "place")
    assert best == [("S1-1", "12", 1, 1), ("S1-1", "corp", 1, 2), ("S1-2", "zeta", 1, 1), ("S1-3", "lane", 1, 1)]


def test_missing_text_is_empty(spark, records):
    made = blocking.with_text(spark.createDataFrame([("S1-1", "S9-9")], "s1 string, cand string"), records)
    assert made.first()["c_name"] == "" and blocking.with_text(made.select("s1", "cand"), records, "inner").isEmpty()


def test_local_weights(spark):
    df = spark.createDataFrame([("a b", "a", "a", "")], "s1_name string, s1_addr string, c_name string, c_addr string")
    found = {r["token"]: r["w"] for r in stats.local_weights(df).collect()}
    assert found == {"a": pytest.approx(0.22314355), "b": pytest.approx(0.91629073)}


def test_ranking_adds_exact_points(records):
    best = {(r["s1"], r["cand"]): r["stage1"] for r in ranking.first_stage(records, 100).collect()}
    assert best["S1-1", "S2-1"] > 30 and best["S1-3", "S3-2"] > 20 and ("S1-1", "S2-2") not in best


def test_f05_example(spark):
    predicted = spark.createDataFrame([("S1-1", "S2-47"), ("S1-1", "S2-193"), ("S1-1", "S3-812")], "s1 string, cand string")
    truth = spark.createDataFrame([("S1-1", "S2-47"), ("S1-1", "S3-812")], "s1 string, cand string")
    alone = spark.createDataFrame([("S1-1",)], "s1 string")
    assert metrics.official(predicted, truth, alone).first()["macro_f05"] == pytest.approx(0.714286, abs=1e-6)
    single = spark.createDataFrame([("S1-2",)], "s1 string")
    assert metrics.official(predicted, truth, alone.union(single)).first()["macro_f05"] == pytest.approx((0.714286 + 1) / 2, abs=1e-6)
    assert metrics.official(predicted, truth.limit(0), alone).first()["macro_f05"] == 0


def test_sweep_takes_first_best(spark):
    scored = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.2), ("c", 1, 0.5)], "s1 string, label int, probability double")
    assert len(metrics.PAIR_SWEEP) == 43 and len(metrics.ENTITY_SWEEP) == 46
    assert metrics.best(metrics.sweep(scored), "f05").first()["threshold"] == 0.22
    assert metrics.sweep(scored.limit(0)).count() == 0


def test_truth_parsing(spark):
    df = spark.createDataFrame([("S1-1", " S2-1,S3-1,,S2-1 "), ("S1-2", ""), ("S1-3", None)], files.TRUTH)
    assert rows(pairs.parse_truth(df)) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]


def test_hard_negatives_are_no_matches(spark, records):
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1 string, cand string")
    made = pairs.training_pairs(truth, records, 100)
    assert rows(made) == [("S1-1", "S2-1", 2, 1)]
    split = pairs.split(made.union(made))
    assert split.select("s1", "is_train").distinct().count() == 1


def test_lists_and_validation(spark, records, tmp_path):
    entities = records.where("source = 1").select(F.col("entity_id").alias("s1"))
    scored = spark.createDataFrame([("S1-1", "S2-2", 2, 0.7), ("S1-1", "S2-1", 2, 0.9), ("S1-1", "S3-1", 3, 0.1)], "s1 string, cand string, cand_source int, probability double")
    lists = output.results(scored, entities, 0.5)
    assert rows(lists) == [("S1-1", "S2-1,S2-2"), ("S1-2", ""), ("S1-3", "")]
    output.check(lists, entities)
    with pytest.raises(ValueError):
        output.check(lists.limit(1), entities)
    output.write(lists, path := str(tmp_path / "out"))
    lines = validate.read_lines(spark, path)
    assert validate.report(validate.issues(lines, "matched_entity_ids", entities))[0]
    assert '"' not in "".join(r["value"] for r in lines.collect())


BAD = {
    "K1_header": ["source1_entity_id,matched_entity_ids", "S1-1\t"], "K2_no_tab": [validate.HEADERS["matched_entity_ids"], "S1-1", "S1-1\t"], "K3_duplicate_row": [validate.HEADERS["matched_entity_ids"], "S1-1\t", "S1-1\t"],
    "K4_repeated_id": [validate.HEADERS["matched_entity_ids"], "S1-1\tS2-1,S2-1"], "K5_source1_id": [validate.HEADERS["matched_entity_ids"], "S1-1\tS1-2"], "K5_prefix": [validate.HEADERS["matched_entity_ids"], 'S1-1\t""'],
    "K5_unknown_id": [validate.HEADERS["matched_entity_ids"], "S1-1\tS2-99"], "K6_missing": [validate.HEADERS["matched_entity_ids"]], "K6_extra": [validate.HEADERS["matched_entity_ids"], "S1-1\t", "S1-9\t"],
}


@pytest.mark.parametrize("rule", BAD)
def test_each_rule(spark, rule):
    lines = spark.createDataFrame([(v, i) for i, v in enumerate(BAD[rule])], "value string, place int")
    required, valid = spark.createDataFrame([("S1-1",)], "s1 string"), spark.createDataFrame([("S2-1",)], "cand string")
    ok, found = validate.report(validate.issues(lines, "matched_entity_ids", required, valid))
    assert not ok and [*found] == [rule]


def test_models(spark, tmp_path):
    data = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 5)) for i in range(200)], "x double, y double, label int")
    for fit in (model.fit_logistic, lambda d, n: model.fit_trees(d, n, trees=3, depth=2)):
        fitted = fit(data, ["x", "y"])
        scored = model.score(fitted, data, ["x", "y"])
        assert scored.where("predicted = (label = 1)").count() >= 195
    assert model.importances(fitted, ["x", "y"])[0][0] == "x"
    model.save(fitted, path := str(tmp_path / "model"))
    assert model.score(model.load(path), data, ["x", "y"]).count() == 200
    with pytest.raises(ValueError):
        model.score(fitted, data.drop("x"), ["x", "y"])


def test_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"unbalanced Ltd\tNA\t\n')
    row = files.read_source(spark, str(tmp_path / "s.tsv")).first()
    assert [*row] == ["S1-1", '"unbalanced Ltd', "NA", None]
    assert files.read_source(spark, str(tmp_path / "s.tsv"), na_strings=["NA"]).first()["business_address"] is None
    empty = spark.createDataFrame([], "a string, b string")
    files.write_delimited(empty, path := str(tmp_path / "empty"), single=True)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["a,b"]
    files.write_threshold(path := str(tmp_path / "t.json"), 0.4, f05=0.9)
    assert files.read_threshold(path) == 0.4
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(KeyError):
        files.read_threshold(str(tmp_path / "bad.json"))
