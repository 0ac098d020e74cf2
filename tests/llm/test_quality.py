from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import quality

from .conftest import DATA, same


def test_equals_sql(spark, duck):
    same(quality.op5_quality_rules(spark, DATA), duck.sql(quality.SQL))


@given(st.text("ab \n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeats(text):
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    assert quality.Document(text).n_repeat_words == len({i + k for i, w in enumerate(windows) if w in many for k in range(3)})


def test_order_is_by_rejection_per_cost():
    costs = {"a": (1.0, 0.5), "b": (0.1, 0.1), "c": (1.0, 0.0)}
    assert quality.order(costs, ["a", "b", "c"]) == ["b", "a", "c"]


def test_odd_rows(odd, empty):
    kept = {r["doc_id"]: r["rejected_by"] for r in quality.cascade(odd).collect()}
    assert quality.cascade(odd).columns == [*(c for c in odd.columns if c != "rejected_by"), "rejected_by"]
    assert kept[5] is None and kept[6] is None and all(kept[k] for k in (0, 1, 2, 3, 10))
    measured = {r["doc_id"]: r for r in quality.measure(odd).collect()}
    assert all(measured[k]["kept"] == (kept[k] is None) for k in kept)
    assert quality.measure(empty).count() == quality.cascade(empty).count() == 0


def test_labels(spark, small):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.measure(small).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert not any(r["kept"] for r in rows if r["quality"] == 0)
