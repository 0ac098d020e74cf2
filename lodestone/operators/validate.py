"""Checks of result files, as one table of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = {"matched_entity_ids": "source1_entity_id\tmatched_entity_ids", "candidate_entity_ids": "source1_entity_id\tcandidate_entity_ids"}


def issues(lines: DataFrame, column: str, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """rule, severity and item of every fault of a list file given as ``lines`` (value, and place
    from 0).  ``required`` (s1): ids that must occur; ``valid`` (cand): ids that may be listed."""
    fault = lambda df, rule, item: df.select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), item.alias("item"))
    header, body = lines.where("place = 0"), lines.where("place > 0 AND value <> ''")
    whole = body.where(F.instr("value", "\t") > 0)
    parts = F.split("value", "\t", 2)
    rows = whole.select(parts[0].alias("s1"), F.when(parts[1] == "", F.array().cast("array<string>")).otherwise(F.split(parts[1], ",")).alias("ids"))
    ids = rows.select("s1", F.explode("ids").alias("id"))
    bad = ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")
    found = [
        fault(header.where(F.col("value") != HEADERS[column]), "K1_header", F.col("value")),
        fault(body.where(F.instr("value", "\t") == 0), "K2_no_tab", F.col("value")),
        fault(rows.groupBy("s1").count().where("count > 1"), "K3_duplicate_row", F.col("s1")),
        fault(rows.where(F.size("ids") != F.size(F.array_distinct("ids"))), "K4_repeated_id", F.col("s1")),
        fault(ids.where(F.col("id").startswith("S1-")), "K5_source1_id", F.col("id")),
        fault(ids.where(bad & ~F.col("id").startswith("S1-")), "K5_prefix", F.col("id")),
        fault(required.join(rows, "s1", "left_anti"), "K6_missing", F.col("s1")),
        fault(rows.select("s1").distinct().join(required, "s1", "left_anti"), "K6_extra", F.col("s1")),
    ]
    if valid is not None:
        unknown = ids.where(~bad).select(F.col("id").alias("cand")).distinct().join(valid, "cand", "left_anti")
        found.append(fault(unknown, "K5_unknown_id", F.col("cand")))
    return reduce(DataFrame.unionByName, found)


def outside_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings: matched pairs (s1, cand) that are no candidates."""
    missing = matched.join(candidates, ["s1", "cand"], "left_anti")
    return missing.select(F.lit("K7_not_a_candidate").alias("rule"), F.lit("warning").alias("severity"), F.concat_ws(" ", "s1", "cand").alias("item"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one file, place 0 being the first."""
    return spark.read.option("wholetext", False).text(path).select("value", F.monotonically_increasing_id().alias("place"))


def report(found: DataFrame, examples: int = 5) -> tuple[bool, dict[str, list[str]]]:
    """Whether there is no error, and a few items of each rule."""
    few = found.groupBy("rule", "severity").agg(F.slice(F.array_sort(F.collect_set("item")), 1, examples).alias("items")).collect()
    return not any(r["severity"] == "error" for r in few), {r["rule"]: r["items"] for r in few}
