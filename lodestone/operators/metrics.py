"""Precision, recall, F0.5, sweeps and dataset statistics.

A table of pairs may be counted (see ``tally``): each row then stands for n pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import share


def f05(tp: Column, fp: Column, fn: Column) -> Column:
    """F0.5 of counts: 1.25 P R / (0.25 P + R), 0 if both are 0."""
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return share(1.25 * p * r, 0.25 * p + r)


def number(pairs: DataFrame, condition: Column | None = None) -> Column:
    """How many of the pairs there are, or meet the condition, as an aggregate."""
    if "n" not in pairs.columns:
        return F.count("*") if condition is None else F.count_if(condition)
    return F.coalesce(F.sum(F.col("n") if condition is None else F.when(condition, F.col("n"))), F.lit(0))


def _counts(pairs: DataFrame, label: str, said: str) -> list[Column]:
    hit, told = F.col(label) == 1, F.col(said)
    return [number(pairs, c).alias(n) for n, c in (("tp", hit & told), ("fp", ~hit & told), ("fn", hit & ~told))]


def _scored(counts: DataFrame, name: str = "f05") -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), name: f05(tp, fp, fn)})


def pair_metrics(scored: DataFrame, threshold: float, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f05 of pairs (probability, label)."""
    told = scored.withColumn("_said", F.col("probability") >= threshold)
    return _scored(told.groupBy(*by).agg(*_counts(told, "label", "_said")))


def entity_macro(scored: DataFrame, threshold: float) -> DataFrame:
    """Mean F0.5 over the queries that have pairs."""
    told = scored.withColumn("_said", F.col("probability") >= threshold)
    return _scored(told.groupBy("s1").agg(*_counts(told, "label", "_said"))).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("n_entities"))


def official(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean F0.5 over all ``entities`` (s1): without a true match 1 if nothing is predicted, else 0."""
    said, true = (df.select("s1", "cand").distinct().withColumn(c, F.lit(1)) for df, c in ((predicted, "_p"), (truth, "_t")))
    per = said.join(true, ["s1", "cand"], "full").groupBy("s1").agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    every = entities.select("s1").distinct().join(per, "s1", "left").fillna(0, ["tp", "fp", "fn"])
    return _official(every)


def official_of_counts(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """``official`` of counted pairs with a label; ``true``: s1 and n_true of every entity."""
    per = predicted.groupBy("s1").agg(number(predicted, F.col("label") == 1).alias("tp"), number(predicted, F.col("label") == 0).alias("fp"))
    every = true.join(per, "s1", "left").fillna(0, ["tp", "fp"])
    return _official(every.withColumn("fn", F.col("n_true") - F.col("tp")))


def _official(every: DataFrame) -> DataFrame:
    single = F.col("tp") + F.col("fn") == 0
    value = F.when(single, (F.col("fp") == 0).cast("double")).otherwise(f05(F.col("tp"), F.col("fp"), F.col("fn")))
    return every.agg(F.avg(value).alias("macro_f05"), F.count_if(single).alias("n_singletons"), F.count("*").alias("n_entities"))


def thresholds(start: int, stop: int, step: int) -> list[float]:
    return [t / 100 for t in range(start, stop + 1, step)]


PAIR_SWEEP, ENTITY_SWEEP = thresholds(10, 94, 2), thresholds(50, 95, 1)


def sweep(scored: DataFrame, at: list[float] | None = None) -> DataFrame:
    """threshold and the pair metrics at each: a pair says yes up to its probability, so one pass
    over the pairs and an explode over the fixed list give all thresholds."""
    at = PAIR_SWEEP if at is None else at
    every = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, at)))).withColumn("_said", F.col("probability") >= F.col("threshold"))
    return _scored(every.groupBy("threshold").agg(*_counts(every, "label", "_said")))


def entity_sweep(scored: DataFrame, at: list[float] | None = None) -> DataFrame:
    at = ENTITY_SWEEP if at is None else at
    every = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, at)))).withColumn("_said", F.col("probability") >= F.col("threshold"))
    return _scored(every.groupBy("threshold", "s1").agg(*_counts(every, "label", "_said"))).groupBy("threshold").agg(F.avg("f05").alias("macro_f05"))


def best(swept: DataFrame, score: str) -> DataFrame:
    """The row of the largest score, the first threshold among equals."""
    return swept.orderBy(F.desc(score), "threshold").limit(1)


def blocking_recall(pairs: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """True pairs, those found, recall, pairs and their mean over all entities, in one row."""
    marked = truth.select("s1", "cand").distinct().join(pairs.select("s1", "cand").distinct().withColumn("_f", F.lit(1)), ["s1", "cand"], "left")
    found = marked.agg(F.count("*").alias("n_true"), F.count("_f").alias("n_found"))
    size = pairs.select("s1", "cand").distinct().agg(F.count("*").alias("n_pairs"))
    return _recall(found, size, entities)


def recall_of_counts(counted: DataFrame, true: DataFrame, entities: DataFrame) -> DataFrame:
    """``blocking_recall`` of counted pairs with a label, and the number of true ones (n, one row)."""
    found = true.withColumnRenamed("n", "n_true").crossJoin(counted.agg(number(counted, F.col("label") == 1).alias("n_found")))
    return _recall(found, counted.agg(number(counted).alias("n_pairs")), entities)


def _recall(found: DataFrame, size: DataFrame, entities: DataFrame) -> DataFrame:
    all_rows = found.crossJoin(size).crossJoin(entities.agg(F.count("*").alias("n_entities")))  # one row each
    return all_rows.withColumns({"recall": share(F.col("n_found"), F.col("n_true")), "mean_candidates": share(F.col("n_pairs"), F.col("n_entities"))})


def candidate_counts(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean, median and largest number of candidates over all entities."""
    per = entities.select("s1").join(pairs.groupBy("s1").agg(number(pairs).alias("n")), "s1", "left").fillna(0, ["n"])
    return per.agg(F.avg("n").alias("mean_candidates"), F.median("n").alias("median_candidates"), F.max("n").alias("max_candidates"))


def truth_cardinality(truth: DataFrame, entities: DataFrame) -> DataFrame:
    per = entities.select("s1").join(truth.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").fillna(0, ["n"])
    return per.agg(F.count("*").alias("n_entities"), F.count_if(F.col("n") == 0).alias("n_singletons"), F.sum("n").alias("n_matches"), F.max("n").alias("max_matches"), F.avg("n").alias("mean_matches"))


def class_balance(pairs: DataFrame) -> DataFrame:
    """Positives, negatives and the weight that makes them equal."""
    counts = pairs.agg(number(pairs, F.col("label") == 1).alias("n_pos"), number(pairs, F.col("label") == 0).alias("n_neg"))
    return counts.withColumn("scale_pos_weight", share(F.col("n_neg"), F.col("n_pos"), 1.0))


def summary(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean, min and max, in one pass."""
    stats = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names)))
    if "n" in features.columns:
        mean = F.sum(F.col("_s.x") * F.col("n")) / F.sum("n")
        return features.select("n", stats.alias("_s")).groupBy("_s.feature").agg(mean.alias("mean"), F.min("_s.x").alias("min"), F.max("_s.x").alias("max"))
    return features.select(stats.alias("_s")).groupBy("_s.feature").agg(F.avg("_s.x").alias("mean"), F.min("_s.x").alias("min"), F.max("_s.x").alias("max"))
