"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue that serves its shuffled documents, pass after pass, at a rate equal to its
target.  The virtual finish time of a draw, that is a document in a pass, is the source's
cumulative words up to its end divided by the source's target.  The mix is the draws in the global
order of their finish times, up to the total budget: the targets add up to it, so it is spent at
virtual time 1, when every queue has served its target.  Draws that finish by then are taken
whole, and of those in service then what has been served.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = "mix-1:"


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """_s (source key), source_size and target for each source of ``sized`` (_s, size).

    Sources in code point order, null last, take ``weights`` in turn and divide ``share`` of all
    words by them; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight until none is above (the water level below).  One row per source."""
    per = sized.groupBy("_s").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy("_s")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled, all_rows = Window.orderBy("ratio", "_s"), Window.partitionBy(F.lit(1))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumn("level", left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("place", F.row_number().over(filled))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(all_rows)
    per = per.withColumn("water", first["level"])
    return per.select("_s", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def queued(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """row (all columns but text), _id, _s (source key), _h (shuffle key), _t (hash of the text), size,
    source_size, target and draws (of each pass that the mix takes anything from: pass, finish, taken)."""
    buckets = max(1, round(docs.count() ** 0.5))
    names = [c for c in docs.columns if c != "text"]
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
        F.col("doc_id").alias("_id"),
        F.regexp_count(common.whole(), F.lit(common.WORD_REGEX)).cast("long").alias("size"),
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("_s"),
        F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"),
        F.xxhash64("text").alias("_t"),
    ).withColumn("_b", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long"))
    sized = common.cut(sized, "sized")
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy("_s", "_b").agg(F.sum("size").alias("_n")).select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    bases = bases.join(targets(sized, weights, share, most), "_s")
    turn = Window.partitionBy("_s", "_b").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.withColumn("_in", F.sum("size").over(turn)).join(bases, ["_s", "_b"]).withColumn("_end", F.col("_base") + F.col("_in"))

    def draw_of(k: int):
        end = F.col("_end") + F.col("source_size") * k
        finish = F.try_divide(end.cast("double"), F.col("target"))
        return F.struct(F.lit(k).alias("pass"), finish.alias("finish"), F.when(end <= F.round("target"), F.col("size")).otherwise(F.greatest(F.lit(0), F.round("target").cast("long") - (end - F.col("size")))).alias("taken"))

    rows = rows.withColumn("virtual_finish", draw_of(0)["finish"]).withColumn("draws", F.filter(F.array(*map(draw_of, range(most))), lambda d: d["taken"] > 0))
    return rows.drop("_b", "_in", "_base", "_end")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """All columns of ``docs`` except text and those named like the new ones, and size, source_size, target, virtual_finish (of the
    first pass) and taken (words the mix takes, at most ``most`` times size), globally sorted by
    virtual finish time.

    Null text has size 0 and takes nothing; a null source is a source of its own, after the
    others; ties in the shuffle are broken by doc_id and size; repeated rows each have their turn;
    an empty table stays empty."""
    made = ("text", "size", "source_size", "target", "virtual_finish", "taken")
    rows = queued(docs, weights, share, most).orderBy("virtual_finish", "_h")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["taken"])
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in made), "size", "source_size", "target", "virtual_finish", taken.alias("taken"))


def draw(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw, in the order of the finish times.  Draws that
    finish within the budget are taken, and of those in service at its end the ones of which at
    least half has been served, so a source misses its target by half a document at most.

    The columns of ``docs``, whatever their names.  Rows without a word are never drawn; a null
    source is a source of its own; equal rows share their draws evenly; an empty table stays empty."""
    draws = queued(docs.select("doc_id", "source", "text"), weights, share, most).select("_id", "_s", "_t", "size", F.explode("draws").alias("d")).where("2 * d.taken >= size")
    draws = draws.groupBy("_id", "_s", "_t").agg(F.sort_array(F.collect_list("d.finish")).alias("at"))  # at most ``most`` for each equal row
    source = F.concat(F.when(F.col("row.source").isNull(), "1").otherwise("0"), F.coalesce("row.source", F.lit("")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", source.alias("s"), F.xxhash64("row.text").alias("t"))
    met = rows.join(draws, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("s") == F.col("_s")) & (F.col("t") == F.col("_t")))
    equal = Window.partitionBy("_id", "_s", "_t")
    met = met.withColumns({"n": F.count("*").over(equal), "i": F.row_number().over(equal.orderBy(F.lit(0)))})
    own = F.filter("at", lambda x, k: k % F.col("n") == F.col("i") - 1)
    drawn = met.select("row", "_id", F.explode(own).alias("finish"))
    return drawn.orderBy("finish", "_id").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    """``mix`` of all documents; see there for nulls, ties, repeated rows and empty tables."""
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


SQL = r"""
WITH sized AS (
  SELECT doc_id, (CASE WHEN source IS NULL THEN '1' ELSE '0' END) || coalesce(source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
per AS (
  SELECT s, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY s) - 1) % 3 + 1]::BIGINT AS weight FROM sized GROUP BY s),
capped AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS ratio FROM per),
levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, s) AS place,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM capped),
water AS (SELECT arg_min(level, place) AS water FROM levels WHERE level * weight <= cap),
targets AS (SELECT s, source_size, coalesce(least(cap::DOUBLE, water * weight), cap::DOUBLE) AS target FROM levels LEFT JOIN water ON true),
queued AS (
  SELECT doc_id, size, s, (sum(size) OVER (PARTITION BY s ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS fin FROM sized)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - (fin - size)))
        + greatest(0, least(size, round(target)::BIGINT - (fin - size + source_size)))
        + greatest(0, least(size, round(target)::BIGINT - (fin - size + 2 * source_size))))::BIGINT AS taken,
       CASE WHEN target <> 0 THEN fin::DOUBLE / target END AS virtual_finish
FROM queued JOIN targets USING (s)
"""
