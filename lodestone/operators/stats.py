"""Token statistics and posting tables.

Record tables have entity_id, source (1, 2, 3), name, addr and country, normalised; a posting is a
row (entity_id, source, country, token).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def postings(records: DataFrame, fields: tuple[str, ...] = ("name", "addr"), min_len: int = 2, distinct: bool = True) -> DataFrame:
    """A row for each token of the fields; without ``distinct`` one for each occurrence."""
    if distinct:
        found: Column = text.joined_tokens(*fields, min_len=min_len)
    else:
        found = F.flatten(F.array(*(text.tokens(f, min_len, distinct=False) for f in fields)))
    return records.select("entity_id", "source", "country", F.explode(found).alias("token"))


def frequency(posted: DataFrame, *by: str, cap: int | None = None, entities: bool = False) -> DataFrame:
    """token and freq (rows, or entities if asked), per ``by``; above ``cap`` they are left out."""
    freq = F.countDistinct("entity_id") if entities else F.count("*")
    counted = posted.groupBy(*by, "token").agg(freq.alias("freq"))
    return counted if cap is None else counted.where(F.col("freq") <= cap)


def log_weight(freq: Column | str = "freq", total: float = 1e6) -> Column:
    return F.log(F.lit(total) / (F.col(freq) + 1 if isinstance(freq, str) else freq + 1))


def log2_weight(freq: str = "freq") -> Column:
    return 1 / F.log2(F.col(freq) + 2)


def inverse_weight(freq: str = "freq") -> Column:
    return 1 / (1 + F.col(freq))


def vocabulary_weights(records: DataFrame, field: str) -> DataFrame:
    """token and w of one field over all sources, by occurrences."""
    return frequency(postings(records, (field,), distinct=False)).select("token", log2_weight().alias("w"))


def local_weights(pairs: DataFrame) -> DataFrame:
    """token and w over the pairs' own texts: each of a pair's four texts counts a token once."""
    texts = pairs.select(F.explode(F.array("s1_name", "s1_addr", "c_name", "c_addr")).alias("t"))
    total = texts.agg(F.count("*").alias("n"))  # one row
    counted = texts.select(F.explode(text.tokens("t", 1)).alias("token")).groupBy("token").agg(F.count("*").alias("f"))
    return counted.crossJoin(F.broadcast(total)).select("token", F.log((F.col("n") + 1) / (F.col("f") + 1)).alias("w"))


def counted_weights(records: DataFrame, counted: DataFrame) -> DataFrame:
    """``local_weights`` of pairs that are counted by record (entity_id, n): a text counts as often
    as its record is in a pair."""
    texts = records.join(counted, "entity_id").select("n", F.explode(F.array("name", "addr")).alias("t"))
    total = counted.agg(F.coalesce(2 * F.sum("n"), F.lit(0)).alias("n"))  # one row
    occurring = texts.select("n", F.explode(text.tokens("t", 1)).alias("token")).groupBy("token").agg(F.sum("n").alias("f"))
    return occurring.crossJoin(F.broadcast(total)).select("token", F.log((F.col("n") + 1) / (F.col("f") + 1)).alias("w"))
