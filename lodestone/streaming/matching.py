"""New query records as a stream, matched against a fixed index of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, stats


def posting_index(records: DataFrame, cap: int) -> DataFrame:
    """token, cand, cand_source and c_country of the usable tokens, to be written once."""
    posted = stats.postings(blocking.candidates_of(records))
    usable = stats.frequency(posted, cap=cap)
    return posted.join(usable, "token").select("token", F.col("entity_id").alias("cand"), F.col("source").alias("cand_source"), F.col("country").alias("c_country"), "freq")


def match(queries: DataFrame, index: DataFrame, k: int, policy: str = "wildcard") -> DataFrame:
    """The ``k`` candidates of each source with the largest weight of shared tokens."""
    mine = stats.postings(queries).select(F.col("entity_id").alias("s1"), "country", "token")
    met = mine.join(index, "token").where(blocking.same_country(policy)).groupBy("s1", "cand", "cand_source").agg(F.round(F.sum(stats.log_weight()), 9).alias("score"))
    return blocking.top_k(met, k, "score", "s1", "cand_source")


def match_stream(queries: DataFrame, index_path: str, out_path: str, checkpoint: str, k: int = 40) -> StreamingQuery:
    """Match each micro-batch and write it under its own number, so that a batch that runs again
    replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        match(batch, spark.read.parquet(index_path), k).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
