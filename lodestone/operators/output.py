"""Result lists and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files


def id_lists(pairs: DataFrame, entities: DataFrame, column: str = "matched_entity_ids", order: str | None = None) -> DataFrame:
    """source1_entity_id and the comma list of its candidates for every entity, '' if none; by
    ``order`` descending, then by id."""
    keys = [F.col("_o").desc(), F.col("cand")] if order else [F.col("cand")]
    distinct = pairs.groupBy("s1", "cand").agg((F.max(order) if order else F.lit(0)).alias("_o"))
    item = F.struct((-F.col("_o").cast("double")).alias("o"), F.col("cand").alias("c")) if keys else None
    lists = distinct.groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]), ",").alias(column))
    return entities.select("s1").distinct().join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def results(scored: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """The match lists: pairs at or above the threshold from a known source, likeliest first."""
    chosen = scored.where((F.col("probability") >= threshold) & F.col("cand_source").isin(2, 3)).dropDuplicates(["s1", "cand", "cand_source"])
    return id_lists(chosen, entities, order="probability")


def check(lists: DataFrame, entities: DataFrame) -> None:
    """One row for each entity, none null; raises otherwise."""
    found = lists.agg(F.count("*").alias("n"), F.countDistinct("source1_entity_id").alias("d"), F.count_if(F.col("matched_entity_ids").isNull()).alias("null")).first()
    expected = entities.select("s1").distinct().count()
    if found["n"] != expected or found["d"] != expected or found["null"]:
        raise ValueError(f"{found['n']} rows, {found['d']} entities and {found['null']} nulls for {expected} entities")


def write(lists: DataFrame, path: str) -> None:
    files.write_delimited(lists, path, sep="\t", single=True)
