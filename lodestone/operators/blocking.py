"""Candidate generation: exact and token blocking, always by equality of a key.

A pair is (s1, cand, cand_source).  Frequency caps bound a token's posting list before the join,
and AQE splits what skew is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def queries_of(records: DataFrame) -> DataFrame:
    return records.where("source = 1")


def candidates_of(records: DataFrame) -> DataFrame:
    return records.where("source > 1")


def same_country(policy: str, mine: str = "country", other: str = "c_country") -> Column:
    equal = F.col(mine) == F.col(other)
    if policy == "strict":
        return equal
    wild = F.col(mine) == ""
    return equal | wild if policy == "left_wildcard" else equal | wild | (F.col(other) == "")


def exact(records: DataFrame, field: str) -> DataFrame:
    """Pairs of equal, non-empty ``field``."""
    mine = queries_of(records).where(F.col(field) != "").select(F.col("entity_id").alias("s1"), field)
    other = candidates_of(records).where(F.col(field) != "").select(F.col("entity_id").alias("cand"), F.col("source").alias("cand_source"), field)
    return mine.join(other, field).select("s1", "cand", "cand_source")


def exact_any(records: DataFrame) -> DataFrame:
    return exact(records, "name").unionByName(exact(records, "addr")).distinct()


def _other(posted: DataFrame) -> DataFrame:
    return posted.select(F.col("entity_id").alias("cand"), F.col("source").alias("cand_source"), F.col("country").alias("c_country"), "token")


def token_pairs(records: DataFrame, cap: int, policy: str = "left_wildcard") -> DataFrame:
    """Pairs that share a token of at most ``cap`` records of the candidate's source."""
    posted = stats.postings(records)
    usable = stats.frequency(candidates_of(posted), "source", cap=cap).select(F.col("source").alias("cand_source"), "token")
    index = _other(candidates_of(posted)).join(usable, ["cand_source", "token"])
    mine = queries_of(posted).select(F.col("entity_id").alias("s1"), "country", "token")
    return mine.join(index, "token").where(same_country(policy)).select("s1", "cand", "cand_source").distinct()


def scored_pairs(records: DataFrame, cap: int) -> DataFrame:
    """Pairs of one country with the summed weight of shared tokens of at most ``cap`` records."""
    posted = stats.postings(records)
    weights = stats.frequency(candidates_of(posted), cap=cap).select("token", stats.log_weight().alias("w"))
    mine = queries_of(posted).select(F.col("entity_id").alias("s1"), "country", "token").join(weights, "token")
    other = _other(candidates_of(posted)).withColumnRenamed("c_country", "country")
    return mine.join(other, ["country", "token"]).groupBy("s1", "cand", "cand_source").agg(F.sum("w").alias("score"))


def rarest_tokens(records: DataFrame, cap: int, k: int = 4, pooled: bool = True) -> DataFrame:
    """s1, country, token, freq and place of each query's ``k`` rarest usable tokens."""
    posted = stats.postings(records)
    usable = stats.frequency(candidates_of(posted) if pooled else posted, cap=cap)
    rank = Window.partitionBy("s1").orderBy("freq", "token")
    mine = queries_of(posted).select(F.col("entity_id").alias("s1"), "country", "token").join(usable, "token")
    return mine.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def rarest_token_pairs(records: DataFrame, cap: int, k: int = 4) -> DataFrame:
    """Pairs of one country that share one of the query's ``k`` rarest tokens."""
    other = _other(stats.postings(candidates_of(records))).withColumnRenamed("c_country", "country")
    return rarest_tokens(records, cap, k).join(other, ["country", "token"]).select("s1", "cand", "cand_source").dropDuplicates()


def shared_counts(records: DataFrame, cap: int, policy: str = "wildcard") -> DataFrame:
    """Pairs and the number of name tokens they share, of tokens with at most ``cap`` occurrences."""
    usable = stats.frequency(stats.postings(candidates_of(records), ("name",), min_len=1, distinct=False), cap=cap).select("token")
    posted = stats.postings(records, ("name",), min_len=1).join(usable, "token")
    mine = queries_of(posted).select(F.col("entity_id").alias("s1"), "country", "token")
    met = mine.join(_other(candidates_of(posted)), "token").where(same_country(policy))
    return met.groupBy("s1", "cand", "cand_source").agg(F.count("*").alias("n_shared"))


def top_k(scored: DataFrame, k: int, score: str, *by: str) -> DataFrame:
    """The ``k`` best of each group by score, ties by candidate id, and their place."""
    rank = Window.partitionBy(*by).orderBy(F.desc(score), "cand")
    return scored.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def top_k_pairs(records: DataFrame, cap: int, k: int, policy: str = "wildcard") -> DataFrame:
    """The production blocker: the ``k`` candidates of each source that share most name tokens,
    and all exact pairs."""
    return best_by_source(records, cap, k, policy).unionByName(exact_any(records)).distinct()


def best_by_source(records: DataFrame, cap: int, k: int, policy: str = "wildcard") -> DataFrame:
    """Of ``top_k_pairs`` those by shared tokens."""
    return top_k(shared_counts(records, cap, policy), k, "n_shared", "s1", "cand_source").select("s1", "cand", "cand_source")


def without(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Anti join: pairs that are no true match."""
    return pairs.join(truth.select("s1", "cand"), ["s1", "cand"], "left_anti")


def within(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Semi join: pairs of the queries (s1) given."""
    return pairs.join(queries.select("s1"), "s1", "left_semi")


def with_text(pairs: DataFrame, records: DataFrame, how: str = "left") -> DataFrame:
    """Add s1_name, s1_addr, s1_country and c_name, c_addr, c_country; missing records are empty
    text, or no row if ``how`` is inner."""
    for side, key in (("s1", "s1"), ("c", "cand")):
        # ids carry their source, so the id is the key
        found = records.select(F.col("entity_id").alias(key), *(F.col(f).alias(f"{side}_{f}") for f in ("name", "addr", "country")))
        pairs = pairs.join(found, key, how)
    return pairs.fillna("", [f"{s}_{f}" for s in ("s1", "c") for f in ("name", "addr", "country")])
