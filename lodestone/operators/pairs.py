"""Ground truth and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocking, stats


def parse_truth(truth: DataFrame) -> DataFrame:
    """s1 and cand from the comma lists of a truth table; blanks and repeats are left out."""
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.select(F.col("source1_entity_id").alias("s1"), F.explode(F.array_distinct(ids)).alias("cand"))


def positives(truth: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs with the source of the candidate; ids of no record are skipped."""
    known = blocking.candidates_of(records).select(F.col("entity_id").alias("cand"), F.col("source").alias("cand_source"))
    return truth.select("s1", "cand").join(known, "cand").select("s1", "cand", "cand_source", F.lit(1).alias("label"))


def hard_negatives(truth: DataFrame, records: DataFrame, cap: int, k: int = 8, rarest: int = 4) -> DataFrame:
    """For each query with a match, the ``k`` non-matches of its country with the largest weight
    of shared tokens, of its ``rarest`` rarest (frequencies over all sources)."""
    queries = truth.select("s1").distinct()
    mine = blocking.within(blocking.rarest_tokens(records, cap, rarest, pooled=False), queries).withColumn("w", stats.inverse_weight())
    other = blocking._other(stats.postings(blocking.candidates_of(records))).withColumnRenamed("c_country", "country")
    scored = mine.join(other, ["country", "token"]).groupBy("s1", "cand", "cand_source").agg(F.round(F.sum("w"), 9).alias("score"))  # sums in another order still tie
    best = blocking.top_k(blocking.without(scored, truth), k, "score", "s1")
    return best.select("s1", "cand", "cand_source", F.lit(0).alias("label"))


def training_pairs(truth: DataFrame, records: DataFrame, cap: int, k: int = 8) -> DataFrame:
    return positives(truth, records).unionByName(hard_negatives(truth, records, cap, k))


def split(pairs: DataFrame, percent: int = 80, seed: int = 42) -> DataFrame:
    """Add is_train, the same for all pairs of a query."""
    return pairs.withColumn("is_train", F.pmod(F.xxhash64("s1", F.lit(seed)), F.lit(100)) < percent)


def head(queries: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queries by id."""
    return queries.orderBy("s1").limit(n)


def shuffled(pairs: DataFrame, seed: int = 42) -> DataFrame:
    return pairs.orderBy(F.xxhash64("s1", "cand", F.lit(seed)))
