"""The pipeline's stages against the operators' brute-force versions, and the registry."""

import corpus_pipeline

from lodestone.llm import packing, quality

from . import test_jaccard, test_lines, test_mixing, test_packing
from .conftest import DATA


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "best_fit_packing"]
    docs = small
    done = {}
    for name in [*stages][:-1]:
        before, docs = docs, stages[name](spark, docs, DATA).cache()
        done[name] = before, docs
        assert docs.columns == small.columns
    before, after = done["quality_rules"]
    assert rows_of(after) == [(d, t) for d, t in rows_of(before) if not any(rule(quality.Document(t)) for rule in quality.RULES.values())]
    before, after = done["line_dedup"]
    assert dict(rows_of(after)) == {d: v[2] for d, v in test_lines.brute(rows_of(before)).items()}
    before, after = done["near_duplicates"]
    assert [d for d, _ in rows_of(after)] == [d for d, _, c in test_jaccard.brute(rows_of(before)) if d == c]
    before, after = done["source_mixing"]
    assert {*rows_of(after)} <= {*rows_of(before)} and after.count() > 0
    packed = stages["best_fit_packing"](spark, docs.dropDuplicates(["doc_id"]), DATA).collect()
    test_packing.check(packed, dict(rows_of(docs)), packing.tokenizer_path())
    assert test_mixing


def test_run_takes_all_stages(spark):
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).drop("sequence_id", "offset").collect())) for _ in range(2))
    assert first == second and first


def test_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    stages = dict(corpus_pipeline.STAGES)
    clashing = odd.withColumns({"_id": F.lit(1), "_gone": F.lit("g"), "_s": F.lit(2.5)})
    kept = stages["quality_rules"](spark, clashing, DATA)
    assert kept.columns == clashing.columns and {r["rejected_by"] for r in kept.collect()} == {"x"}
    lined = stages["line_dedup"](spark, clashing, DATA)
    assert lined.columns == clashing.columns and lined.count() == odd.count() and {r["_gone"] for r in lined.collect()} == {"g"}
    more = clashing.unionByName(clashing.where("doc_id IS NULL OR doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    alone = stages["near_duplicates"](spark, more, DATA)
    ids = sorted((r["doc_id"] for r in alone.collect()), key=lambda x: (x is not None, x))
    # 6 is a copy of 5, 7 a near copy, and so is 5 without its id; the row without id stays once, 5 in both of its rows
    assert alone.columns == clashing.columns and ids == [None, *sorted([5, *(k for k in range(14) if k not in (6, 7))])]
    mixed = stages["source_mixing"](spark, clashing, DATA)
    assert mixed.columns == clashing.columns and 0 < mixed.count() <= 3 * odd.count() and all((r["text"] or "").split() for r in mixed.collect())
    packed = stages["best_fit_packing"](spark, clashing, DATA)
    assert packed.select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()
    for stage in stages.values():
        assert stage(spark, empty, DATA).count() == 0
