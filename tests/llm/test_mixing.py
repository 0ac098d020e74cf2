from lodestone.llm import mixing

from .conftest import DATA, same


def test_equals_sql(spark, duck):
    same(mixing.op4_source_mixing(spark, DATA), duck.sql(mixing.SQL))


def test_targets_are_met(odd):
    rows = mixing.mix(odd).collect()
    words = lambda t: len((t or "").split())
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert len(rows) == odd.count() and sum(r["size"] for r in rows) == sum(words(r["text"]) for r in odd.collect())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows) and {r["doc_id"] for r in rows} == {d for d, _ in texts}
    taken, target = {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    finish = [r["virtual_finish"] for r in rows if r["virtual_finish"] is not None]
    assert finish == sorted(finish)


def test_excess_is_shared(spark):
    sized = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 990)], "_s string, size long")
    found = {r["_s"]: r["target"] for r in mixing.targets(sized).collect()}
    # a stops at 30; the other 1970 are shared 2 to 1
    assert found == {"0a": 30.0, "0b": 1970 / 3 * 2, "0c": 1970 / 3}


def test_empty_and_wordless(empty, spark):
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(none).collect()] == [(0, 0.0)] * 2
    assert mixing.draw(none).count() == 0


def test_draw_keeps_columns(odd):
    drawn = mixing.draw(odd)
    assert drawn.columns == odd.columns and 0 < drawn.count() <= 3 * odd.count()


def test_draw_meets_the_targets_with_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a", "w " * 20, 0)] * 4 + [(5, "b", "v " * 20, 0)] * 2 + [(None, None, "u " * 10, 0), (None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _id int")
    targets = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert mixing.mix(docs).columns == ["doc_id", "source", "_id", "size", "source_size", "target", "virtual_finish", "taken"]
    drawn = {}
    for r in mixing.draw(docs).collect():
        drawn[r["source"]] = drawn.get(r["source"], 0) + len(r["text"].split())
    assert drawn.keys() == targets.keys() and all(abs(drawn[s] - targets[s]) <= 10 for s in drawn)
