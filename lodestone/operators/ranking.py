"""Two-stage ranking of candidates and recall at K."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..sources import files
from . import blocking, stats


def first_stage(records: DataFrame, cap: int) -> DataFrame:
    """Pairs of one country with the weight of shared tokens, 30 for an equal name and 20 for an
    equal address."""
    scored = blocking.scored_pairs(records, cap).select("s1", "cand", "cand_source", F.col("score").alias("points"))
    for field, points in (("name", 30.0), ("addr", 20.0)):
        met = blocking.exact(records, field)
        mine = records.select(F.col("entity_id").alias("s1"), "country")
        other = records.select(F.col("entity_id").alias("cand"), F.col("country").alias("c_country"))
        met = met.join(mine, "s1").join(other, "cand").where("country = c_country")
        scored = scored.unionByName(met.select("s1", "cand", "cand_source", F.lit(points).alias("points")))
    return scored.groupBy("s1", "cand", "cand_source").agg(F.round(F.sum("points"), 9).alias("stage1"))


#: Records of either side whose tokens a task of the second stage holds at once, and the least numbers of parts.
HELD, PARTS = 1 << 16, {"s1": 2, "cand": 3}


def numbered(records: DataFrame) -> DataFrame:
    """``records``, written, with _id, a number in the order of entity_id, and numbers of their texts
    within a country: _n (name) and _a (address), 0 where no record of the other side has the text,
    -1 where it is empty.  What is shuffled below has these numbers instead of ids and texts."""
    hashed = {k: F.when(F.col(f) != "", F.xxhash64(f)) for k, f in (("_n", "name"), ("_a", "addr"))}
    made = records.select("entity_id", "source", "country", "name", "addr").orderBy("entity_id").withColumns({"_id": F.monotonically_increasing_id()} | hashed)
    made = files.kept(made, "records")
    for k in hashed:
        both = made.where(F.col(k).isNotNull()).groupBy("country", k).agg(F.count_if(F.col("source") == 1).alias("_q"), F.count_if(F.col("source") > 1).alias("_c")).where("_q > 0 AND _c > 0")
        both = files.kept(both.select("country", k, (F.monotonically_increasing_id() + 1).alias(f"_{k}")), "texts")
        # null meets null nowhere, so an empty text is known by its null
        made = made.join(both, ["country", k], "left").withColumn(k, F.when(F.col(k).isNull(), -1).otherwise(F.coalesce(f"_{k}", F.lit(0)))).drop(f"_{k}")
    return files.kept(made, "numbered")


def _lists(ids: DataFrame, by: list[str]) -> DataFrame:
    """For each of ``by`` the arrays _ids, _ns and _as of its records."""
    found = ids.groupBy(*by).agg(F.collect_list(F.struct("_id", "_n", "_a")).alias("_all"))
    return found.select(*(F.col(c).alias(f"{c}1" if c in ("_n", "_a") else c) for c in by), *(F.col("_all")[c].alias(f"{c}s") for c in ("_id", "_n", "_a")))


def _scored(records: DataFrame, cap: int) -> DataFrame:
    """s1, its texts' numbers, score and the arrays of candidates that have a usable token, one row for
    each of a query's tokens; tokens are compared by 64-bit hashes."""
    tokens = F.transform(text.joined_tokens("name", "addr"), lambda t: F.xxhash64(t))
    posted = records.select("_id", "source", "country", "_n", "_a", F.explode(tokens).alias("token"))
    met = posted.groupBy("token").agg(F.count_if(F.col("source") > 1).alias("freq"), F.count_if(F.col("source") == 1).alias("_m")).where(F.col("freq").between(1, cap) & (F.col("_m") > 0))
    usable = files.kept(posted.join(met.select("token", stats.log_weight().alias("w")), "token"), "postings")
    mine = blocking.queries_of(usable).select(F.col("_id").alias("s1"), "country", "token", F.col("w").alias("score"), F.col("_n").alias("_n1"), F.col("_a").alias("_a1"))
    return mine.join(_lists(blocking.candidates_of(usable), ["country", "token"]), ["country", "token"]).drop("country", "token")


def _best(records: DataFrame, cap: int, keep: int) -> DataFrame:
    """``best_first`` of ``numbered`` records: s1 and cand are numbers, and cand_source is left out."""
    columns = ["s1", "_n1", "_a1", "score", "_ids", "_ns", "_as"]
    met = _scored(records, cap).select(*columns)
    for by in (["_n"], ["_a"], ["_n", "_a"]):
        own = records.where(" AND ".join(f"{k} > 0" for k in by)).select("_id", "source", "country", "_n", "_a")
        place = Window.partitionBy("country", *by).orderBy("_id")
        first = _lists(blocking.candidates_of(own).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= keep), ["country", *by])
        mine = blocking.queries_of(own).select(F.col("_id").alias("s1"), "country", F.col("_n").alias("_n1"), F.col("_a").alias("_a1"), F.lit(0.0).alias("score"))
        met = met.unionByName(mine.join(first, ["country", *(f"{k}1" for k in by)]).select(*columns))
    # all that a query meets goes to one task, as arrays; it lists, sums and ranks the pairs
    met = met.repartition("s1").select("s1", "_n1", "_a1", "score", F.inline(F.arrays_zip("_ids", "_ns", "_as")))
    equal = {k: F.col(f"{k}1") == F.col(f"{k}s") for k in ("_n", "_a")}
    base = 30 * sim.flag(equal["_n"] & (F.col("_n1") > 0)) + 20 * sim.flag(equal["_a"] & (F.col("_a1") > 0))
    both = equal["_n"] & equal["_a"] & (F.col("_n1") != 0) & (F.col("_a1") != 0)
    met = met.select("s1", F.col("_ids").alias("cand"), "score", base.alias("_base"), both.alias("alike"))
    summed = met.groupBy("s1", "cand").agg(F.round(F.sum("score") + F.max("_base"), 9).alias("stage1"), F.first("alike").alias("alike"))
    return blocking.top_k(summed, keep, "stage1", "s1").drop("place")


def best_first(records: DataFrame, cap: int, keep: int) -> DataFrame:
    """The ``keep`` best pairs of each query by ``first_stage``, ties by candidate id, without a row
    for each pair of equal texts; ``alike`` says whether name and address are equal.

    A candidate of equal text that isn't among the first ``keep`` of its group by id has so many
    before it: they have its points and a smaller id, or more points for tokens.  So these and the
    pairs with shared tokens are all that can be kept.  Texts are compared by 64-bit hashes."""
    ids = (records := numbered(records)).select("_id", "entity_id", "source")
    found = _best(records, cap, keep).withColumnsRenamed({"s1": "_s1", "cand": "_cand"})
    found = found.join(ids.select(F.col("_id").alias("_s1"), F.col("entity_id").alias("s1")), "_s1")
    return found.join(ids.select(F.col("_id").alias("_cand"), F.col("entity_id").alias("cand"), F.col("source").alias("cand_source")), "_cand").drop("_s1", "_cand")


def _sides(records: DataFrame, side: str, key: str) -> DataFrame:
    """The id of a record, the numbers of its texts, and its token and number sets, as 64-bit hashes,
    made once for each record and not for each of its pairs."""
    hashed = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
    sets = {"tok_name": text.tokens("name"), "tok_addr": text.tokens("addr"), "num": text.numbers(F.concat_ws(" ", "name", "addr"))}
    if side == "s1":  # what its address hasn't; both together are all tokens
        sets["tok_name"] = F.array_except(sets["tok_name"], sets["tok_addr"])
    more = [F.col("source").alias("cand_source")] if side == "c" else []
    return records.select(F.col("_id").alias(key), F.col("entity_id").alias(f"{side}_id"), *more, F.col("_n").alias(f"{side}_name"), F.col("_a").alias(f"{side}_addr"), *(hashed(c).alias(f"{side}_{w}") for w, c in sets.items()))


def second_stage(ranked: DataFrame, records: DataFrame) -> DataFrame:
    """Add stage2 to ``_best`` of ``numbered`` records, and ids instead of numbers: stage 1 and fixed
    shares of exact fields, token and number measures.  The name measures compare all tokens of the
    query with the candidate's name tokens.

    Queries and candidates are parted, and each goes to all parts of the others, so no row with the
    tokens of a pair is shuffled; a task holds the tokens of one part of either side.  With fewer parts
    than spark.sql.shuffle.partitions Spark would deal all anew by both keys, pairs with tokens too."""
    n = records.agg(F.count_if(F.col("source") == 1).alias("s1"), F.count_if(F.col("source") > 1).alias("cand")).first()
    parts = {k: max(least, -(-n[k] // HELD)) for k, least in PARTS.items()}
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(parts[key]))
    every = lambda key: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[key] - 1).cast("long")))
    dealt = lambda df, i, j: df.withColumn("_i", i).withColumn("_part", F.col("_i") * parts["cand"] + j).drop("_i").repartition(parts["s1"] * parts["cand"], "_part")
    mine = dealt(_sides(blocking.queries_of(records), "s1", "s1").withColumn("_j", every("cand")), place("s1"), F.col("_j")).drop("_j").hint("shuffle_hash")
    other = dealt(_sides(blocking.candidates_of(records), "c", "cand"), every("s1"), place("cand")).hint("shuffle_hash")
    pairs = dealt(ranked, place("s1"), place("cand")).join(other, ["_part", "cand"]).join(mine, ["_part", "s1"])
    pairs = pairs.withColumns({"_n": sim.shared("s1_tok_name", "c_tok_name") + sim.shared("s1_tok_addr", "c_tok_name"), "_a": sim.shared("s1_tok_addr", "c_tok_addr"), "_d": sim.shared("s1_num", "c_num")})
    size = {"all": F.size("s1_tok_name") + F.size("s1_tok_addr"), "name": F.size("c_tok_name")} | {f"{s}_{w}": F.size(f"{s}_{w}") for s in ("s1", "c") for w in ("tok_addr", "num")}
    exact = lambda f: sim.flag((F.col(f"s1_{f}") == F.col(f"c_{f}")) & (F.col(f"s1_{f}") > 0))
    either = lambda n, a, b: size[a] + size[b] - F.col(n)
    least = lambda a, b: F.least(size[a], size[b])
    stage2 = (
        F.col("stage1") + 25 * exact("name") + 15 * exact("addr")
        + 8 * sim.share(F.col("_n"), either("_n", "all", "name")) + 5 * sim.share(F.col("_n"), least("all", "name"))
        + 4 * sim.share(F.col("_a"), either("_a", "s1_tok_addr", "c_tok_addr")) + 4 * sim.share(F.col("_d"), least("s1_num", "c_num"))
    )
    ids = [F.col("s1").alias("_s1"), F.col("cand").alias("_cand"), F.col("s1_id").alias("s1"), F.col("c_id").alias("cand"), "cand_source"]
    return files.kept(pairs.select(*ids, "stage1", "alike", F.round(stage2, 9).alias("stage2")), "second-stage", spark_sql_requireAllClusterKeysForCoPartition="false", spark_sql_shuffle_partitions=str(parts["s1"] * parts["cand"]))


def rank(records: DataFrame, cap: int, keep: int = 300) -> DataFrame:
    """s1, cand, cand_source, stage1, stage2, alike (equal texts) and place after both stages.  The
    first stage has left ``keep`` pairs of a query, so where no place is asked for none is made."""
    records = numbered(records)
    found = second_stage(files.kept(_best(records, cap, keep), "first-stage"), records)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("_s1").orderBy(F.desc("stage2"), "_cand"))).drop("_s1", "_cand")


def recall_of_best(ranked: DataFrame, true_pairs: DataFrame, ks: tuple[int, ...] = (25, 50, 100, 200, 500)) -> DataFrame:
    """``recall_at`` where the true pairs are those of one country and text, and given as their
    number (n): of a group of copies they are never listed."""
    found = ranked.agg(*(F.count_if(F.col("alike") & (F.col("place") <= k)).alias(str(k)) for k in ks))
    per = found.crossJoin(F.broadcast(true_pairs.select(F.col("n").alias("total")))).unpivot(["total"], [str(k) for k in ks], "k", "found")  # one row each
    return per.select(F.col("k").cast("int").alias("k"), "found", "total", sim.share(F.col("found"), F.col("total")).alias("recall"))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (25, 50, 100, 200, 500), exclude_empty: bool = False) -> DataFrame:
    """k, found, total and recall for each k; ``exclude_empty`` leaves queries without a candidate
    out of the total."""
    if exclude_empty:
        truth = truth.join(ranked.select("s1").distinct(), "s1", "left_semi")
    joined = truth.select("s1", "cand").join(ranked.select("s1", "cand", "place"), ["s1", "cand"], "left")
    sums = joined.agg(F.count("*").alias("total"), *(F.count_if(F.col("place") <= k).alias(str(k)) for k in ks))
    per = sums.unpivot(["total"], [str(k) for k in ks], "k", "found")
    return per.select(F.col("k").cast("int").alias("k"), "found", "total", sim.share(F.col("found"), F.col("total")).alias("recall"))
