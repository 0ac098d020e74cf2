"""Every query of the library by name, and its SQL where SQL can express it.

All run over whole tables.  The SQL shares the definition of the records and is written apart from
the operators otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..operators import blocking, features, metrics, model, output, pairs, ranking, stats, tally, validate
from ..sources import files
from . import fixture
from .fixture import CAP, TOP

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RECORDS = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, (doc_id % 3 + 1)::INT AS source, lower(trim(coalesce(lang, ''))) AS country,
         trim(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^\p{L}\p{N}_]+', ' ', 'g')) AS whole FROM documents),
rec AS (
  SELECT 'S' || source || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, source, country, whole,
         array_to_string(string_split(whole, ' ')[1:6], ' ') AS name, array_to_string(string_split(whole, ' ')[7:], ' ') AS addr FROM base),
occ AS (
  SELECT entity_id, source, country, unnest(list_filter(string_split(name, ' ') || string_split(addr, ' '), lambda x: length(x) >= 2)) AS token FROM rec),
post AS (SELECT DISTINCT entity_id, source, country, token FROM occ),
df23 AS (SELECT token, count(*) AS freq FROM post WHERE source > 1 GROUP BY token),
use23 AS (SELECT * FROM df23 WHERE freq <= 50),
truth AS (
  SELECT a.entity_id AS s1, b.entity_id AS cand, b.source AS cand_source FROM rec a JOIN rec b ON a.source = 1 AND b.source > 1 AND a.country = b.country AND a.whole = b.whole),
exname AS (SELECT a.entity_id AS s1, b.entity_id AS cand, b.source AS cand_source FROM rec a JOIN rec b ON a.source = 1 AND b.source > 1 AND a.name = b.name AND a.name <> ''),
exaddr AS (SELECT a.entity_id AS s1, b.entity_id AS cand, b.source AS cand_source FROM rec a JOIN rec b ON a.source = 1 AND b.source > 1 AND a.addr = b.addr AND a.addr <> ''),
exany AS (SELECT * FROM exname UNION SELECT * FROM exaddr),
nocc AS (SELECT entity_id, source, country, unnest(list_filter(string_split(name, ' '), lambda x: x <> '')) AS token FROM rec),
nuse AS (SELECT token FROM nocc WHERE source > 1 GROUP BY token HAVING count(*) <= 50),
npost AS (SELECT DISTINCT nocc.* FROM nocc JOIN nuse USING (token)),
nshared AS (
  SELECT a.entity_id AS s1, b.entity_id AS cand, b.source AS cand_source, count(*) AS n_shared
  FROM npost a JOIN npost b ON a.source = 1 AND b.source > 1 AND a.token = b.token AND a.country = b.country GROUP BY ALL),
nbest AS (SELECT * FROM nshared QUALIFY row_number() OVER (PARTITION BY s1, cand_source ORDER BY n_shared DESC, cand) <= 5),
pair AS (SELECT s1, cand, cand_source FROM nbest UNION SELECT * FROM exany),
ptext AS (
  SELECT p.*, a.name AS s1_name, a.addr AS s1_addr, a.country AS s1_country, b.name AS c_name, b.addr AS c_addr, b.country AS c_country
  FROM pair p JOIN rec a ON p.s1 = a.entity_id JOIN rec b ON p.cand = b.entity_id),
ptok AS (
  SELECT *, list_filter(string_split(s1_name, ' '), lambda x: length(x) >= 2) AS an, list_filter(string_split(c_name, ' '), lambda x: length(x) >= 2) AS bn,
         list_filter(string_split(s1_addr, ' '), lambda x: length(x) >= 2) AS aa, list_filter(string_split(c_addr, ' '), lambda x: length(x) >= 2) AS ba,
         regexp_extract_all(s1_name || ' ' || s1_addr, '[0-9]+') AS ax, regexp_extract_all(c_name || ' ' || c_addr, '[0-9]+') AS bx FROM ptext),
feat AS (
  SELECT s1, cand, cand_source,
    CASE WHEN s1_name <> '' AND s1_name = c_name THEN 1.0 ELSE 0.0 END::DOUBLE AS name_exact, CASE WHEN s1_addr <> '' AND s1_addr = c_addr THEN 1.0 ELSE 0.0 END::DOUBLE AS addr_exact,
    coalesce(len(list_intersect(an, bn))::DOUBLE / nullif(len(list_distinct(an || bn)), 0), 1) AS name_token_jaccard,
    coalesce(len(list_intersect(aa, ba))::DOUBLE / nullif(len(list_distinct(aa || ba)), 0), 1) AS addr_token_jaccard,
    coalesce(len(list_intersect(an, bn))::DOUBLE / nullif(least(len(an), len(bn)), 0), 0) AS name_token_overlap,
    coalesce(len(list_intersect(aa, ba))::DOUBLE / nullif(least(len(aa), len(ba)), 0), 0) AS addr_token_overlap,
    coalesce(least(length(s1_name), length(c_name))::DOUBLE / nullif(greatest(length(s1_name), length(c_name)), 0), 1) AS name_length_ratio,
    coalesce(least(length(s1_addr), length(c_addr))::DOUBLE / nullif(greatest(length(s1_addr), length(c_addr)), 0), 1) AS addr_length_ratio,
    (s1_name <> '' AND c_name <> '' AND substr(s1_name, 1, 4) = substr(c_name, 1, 4))::INT::DOUBLE AS name_prefix4, (s1_addr <> '' AND c_addr <> '' AND substr(s1_addr, 1, 4) = substr(c_addr, 1, 4))::INT::DOUBLE AS addr_prefix4,
    (s1_name <> '' AND c_name <> '' AND right(s1_name, 4) = right(c_name, 4))::INT::DOUBLE AS name_suffix4, (s1_addr <> '' AND c_addr <> '' AND right(s1_addr, 4) = right(c_addr, 4))::INT::DOUBLE AS addr_suffix4,
    len(list_intersect(an, bn))::DOUBLE AS name_shared_tokens, len(list_intersect(aa, ba))::DOUBLE AS addr_shared_tokens,
    coalesce(len(list_intersect(ax, bx))::DOUBLE / nullif(least(len(ax), len(bx)), 0), 0) AS number_overlap,
    coalesce(ax[1] = bx[1], false)::INT::DOUBLE AS first_number_match
  FROM ptok),
scored AS (
  SELECT s1, cand, f.cand_source, (t.s1 IS NOT NULL)::INT AS label, round((2 * name_token_jaccard + addr_token_jaccard) / 3, 6) AS probability
  FROM feat f LEFT JOIN truth t USING (s1, cand)),
ent AS (SELECT entity_id AS s1 FROM rec WHERE source = 1)
"""

P, R, F05 = "coalesce({tp}::DOUBLE / nullif({tp} + {fp}, 0), 0)", "coalesce({tp}::DOUBLE / nullif({tp} + {fn}, 0), 0)", "coalesce(1.25 * {p} * {r} / nullif(0.25 * {p} + {r}, 0), 0)"


def _f05(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> tuple[str, str, str]:
    p, r = (x.format(tp=tp, fp=fp, fn=fn) for x in (P, R))
    return p, r, F05.format(p=p, r=r)


def query(name: str, sql: str | None = None, prefix: str = RECORDS):
    """Register a query; ``sql`` follows the definition of the records."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = prefix + sql
        return f

    return add


def on_records(name: str, sql: str | None = None):
    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(fixture.records(spark, sf_dir)))
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Sources and sinks

RAW = """SELECT 'S' || (doc_id % 3 + 1) || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, nullif(translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   '), '') AS business_name,
nullif(coalesce(source, ''), '') AS business_address, nullif(coalesce(lang, ''), '') AS country FROM documents"""


@query("io1_tsv_round_trip", RAW, "")
def _(spark, sf_dir):
    files.write_delimited(fixture.raw_sources(spark, sf_dir), path := files.scratch(spark, "tsv"), sep="\t")
    return files.read_source(spark, path)


@query("io2_column_pruning", "SELECT country, count(*) AS n FROM rec GROUP BY country")
def _(spark, sf_dir):
    return fixture.documents(spark, sf_dir).select(text.country("lang").alias("country")).groupBy("country").agg(F.count("*").alias("n"))


@query("io4_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", "")
def _(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    files.write_delimited(customers, path := files.scratch(spark, "csv"))
    return files.read_csv(spark, path, customers.schema)


@query("io5_parquet_list", "SELECT * FROM (SELECT n_name AS name FROM nation) UNION ALL SELECT r_name FROM region", "")
def _(spark, sf_dir):
    return files.read_parquet(spark, f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name")).unionByName(files.read_parquet(spark, f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name")))


@query("io6_registered_view", "SELECT v.code, n.n_name FROM (VALUES (0, 'zero'), (1, 'one')) v(id, code) JOIN nation n ON n.n_regionkey = v.id", "")
def _(spark, sf_dir):
    files.register(spark, "codes", [(0, "zero"), (1, "one")], "id int, code string")
    files.register(spark, "nations", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return spark.sql("SELECT v.code, n.n_name FROM codes v JOIN nations n ON n.n_regionkey = v.id")


@query("io8_describe")
def _(spark, sf_dir):
    return files.describe(fixture.documents(spark, sf_dir))


@query("io9_parquet_zstd", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders", "")
def _(spark, sf_dir):
    files.write_parquet(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), path := files.scratch(spark, "orders"))
    return spark.read.parquet(path)


@query("io14_cache_if_absent", "SELECT entity_id, whole AS name_norm, trim(regexp_replace(lower(coalesce(source_name, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS addr_norm, country AS country_norm FROM rec JOIN (SELECT 'S' || (doc_id % 3 + 1) || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, source AS source_name FROM documents) USING (entity_id)")
def _(spark, sf_dir):
    raw, path = fixture.raw_sources(spark, sf_dir), files.scratch(spark, "cache")
    files.build_cache(spark, raw, path)
    return files.build_cache(spark, raw.limit(0), path)  # it is there, so nothing is made anew


# Scalars


@on_records("p1_normalize", "SELECT entity_id, whole FROM rec")
def _(r):
    return r.select("entity_id", "whole")


@query("p2_normalize_nfkc")
def _(spark, sf_dir):
    return fixture.documents(spark, sf_dir).select("doc_id", text.normalize("text", nfkc=True).alias("whole"))


@on_records("p3_country", "SELECT entity_id, country, trim(regexp_replace(country, '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS full_country FROM rec")
def _(r):
    return r.select("entity_id", "country", text.country("country", full=True).alias("full_country"))


@on_records("p4_token_sets", """SELECT entity_id, len(list_distinct(list_filter(string_split(whole, ' '), lambda x: length(x) >= 2)))::INT AS n_set,
len(list_distinct(list_filter(string_split(whole, ' '), lambda x: x <> '')))::INT AS n_set_all, len(list_filter(string_split(whole, ' '), lambda x: length(x) >= 2))::INT AS n_list,
array_to_string(list_sort(list_distinct(list_filter(string_split(name, ' '), lambda x: length(x) >= 2))), ' ') AS name_set FROM rec""")
def _(r):
    return r.select("entity_id", F.size(text.tokens("whole")).alias("n_set"), F.size(text.tokens("whole", 1)).alias("n_set_all"), F.size(text.tokens("whole", 2, False)).alias("n_list"), F.array_join(F.array_sort(text.tokens("name")), " ").alias("name_set"))


@on_records("p7_token_column", "SELECT entity_id, unnest(list_filter(string_split(name, ' '), lambda x: x <> '')) AS token FROM rec")
def _(r):
    listed = r.withColumn("name", F.split("name", " "))
    return listed.select("entity_id", F.explode(text.token_column("name", listed.schema["name"].dataType)).alias("token"))


@on_records("p9_numbers", "SELECT entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(whole, '[0-9]+'))), ' ') AS numbers, len(regexp_extract_all(whole, '[0-9]+'))::INT AS n_numbers, coalesce(regexp_extract(whole, '[0-9]+'), '') AS first_number, regexp_replace(whole, '[^\\p{Nd}]', '', 'g') AS digits FROM rec")
def _(r):
    return r.select("entity_id", F.array_join(F.array_sort(text.numbers("whole")), " ").alias("numbers"), F.size(text.numbers("whole", False)).alias("n_numbers"), text.first_number("whole").alias("first_number"), text.digits_only("whole").alias("digits"))


@on_records("p12_string_functions", "SELECT entity_id, length(whole)::INT AS n, substr(whole, 1, 4) AS head, right(whole, 4) AS tail, name || '|' || country AS joined, starts_with(entity_id, 'S1-') AS is_s1, trim('  ' || name || ' ') AS trimmed FROM rec")
def _(r):
    return r.select("entity_id", F.length("whole").alias("n"), F.substring("whole", 1, 4).alias("head"), F.right("whole", F.lit(4)).alias("tail"), F.concat("name", F.lit("|"), "country").alias("joined"), F.startswith("entity_id", F.lit("S1-")).alias("is_s1"), F.trim(F.concat(F.lit("  "), "name", F.lit(" "))).alias("trimmed"))


@on_records("p13_list_functions", """SELECT entity_id, len(list_intersect(string_split(name, ' '), string_split(addr, ' ')))::INT AS n_both, len(list_distinct(string_split(name, ' ') || string_split(addr, ' ')))::INT AS n_any, len(string_split(name, ' ') || string_split(addr, ' '))::INT AS n_all FROM rec""")
def _(r):
    a, b = F.split("name", " "), F.split("addr", " ")
    return r.select("entity_id", F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_union(a, b)).alias("n_any"), F.size(F.concat(a, b)).alias("n_all"))


@on_records("p14_weights", "SELECT token, freq, round(ln(1e6 / (freq + 1)), 6) AS log_w, round(1 / log2(freq + 2), 6) AS log2_w, round(1.0::DOUBLE / (1 + freq), 6) AS inverse_w, (freq // 10)::BIGINT AS tens, greatest(freq, 2) AS at_least FROM df23")
def _(r):
    freq = stats.frequency(stats.postings(blocking.candidates_of(r)))
    return freq.select("token", "freq", F.round(stats.log_weight(), 6).alias("log_w"), F.round(stats.log2_weight(), 6).alias("log2_w"), F.round(stats.inverse_weight(), 6).alias("inverse_w"), F.floor(F.col("freq") / 10).alias("tens"), F.greatest("freq", F.lit(2)).alias("at_least"))


@on_records("p15_flags", "SELECT entity_id, CASE WHEN name = '' THEN 'none' WHEN addr = '' THEN 'name' ELSE 'both' END AS filled, (country = 'en')::INT::DOUBLE AS is_en FROM rec")
def _(r):
    return r.select("entity_id", F.when(F.col("name") == "", "none").when(F.col("addr") == "", "name").otherwise("both").alias("filled"), sim.flag(F.col("country") == "en").alias("is_en"))


@on_records("p16_predicates", "SELECT entity_id FROM rec WHERE country IN ('en', 'de') AND name <> '' AND source IS NOT NULL AND (addr IS NULL OR length(addr) BETWEEN 10 AND 2000) AND entity_id LIKE 'S%'")
def _(r):
    return r.where(F.col("country").isin("en", "de") & (F.col("name") != "") & F.col("source").isNotNull() & (F.col("addr").isNull() | F.length("addr").between(10, 2000)) & F.col("entity_id").startswith("S")).select("entity_id")


@on_records("p17_rename_drop", "SELECT entity_id AS id, name AS business_name FROM rec")
def _(r):
    return r.withColumnRenamed("entity_id", "id").withColumnRenamed("name", "business_name").drop("addr", "country", "whole", "source")


@on_records("p18_lookup", "SELECT p.s1, p.cand, CASE WHEN EXISTS (SELECT 1 FROM rec WHERE source = 2 AND entity_id = p.cand) THEN 0 ELSE 1 END AS source_code, (SELECT any_value(name) FROM rec WHERE entity_id = p.cand) AS cand_name FROM pair p")
def _(r):
    second, third = (r.where(F.col("source") == k).select(F.col("entity_id").alias("cand"), F.col("name").alias(f"n{k}")) for k in (2, 3))
    found = fixture.pairs(r).join(second, "cand", "left").join(third, "cand", "left")
    return found.select("s1", "cand", F.when(F.col("n2").isNotNull(), 0).otherwise(1).alias("source_code"), F.coalesce("n2", "n3").alias("cand_name"))


@on_records("p20_profile", "SELECT 'name' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE trim(name) = '') AS n_empty FROM rec UNION ALL SELECT 'addr', count(*), count(*) FILTER (WHERE trim(addr) = '') FROM rec UNION ALL SELECT 'country', count(*), count(*) FILTER (WHERE trim(country) = '') FROM rec")
def _(r):
    return files.profile(r.select("name", "addr", "country"))


# Joins and blocking

on_records("j1_exact_name", "SELECT * FROM exname")(lambda r: blocking.exact(r, "name"))
on_records("j1_exact_address", "SELECT * FROM exaddr")(lambda r: blocking.exact(r, "addr"))
on_records("j1_exact_any", "SELECT * FROM exany")(blocking.exact_any)
on_records("j2_token_blocking", """SELECT DISTINCT a.entity_id AS s1, b.entity_id AS cand, b.source AS cand_source FROM post a JOIN post b ON a.source = 1 AND b.source > 1 AND a.token = b.token AND (a.country = '' OR a.country = b.country)
JOIN (SELECT source, token FROM post WHERE source > 1 GROUP BY source, token HAVING count(*) <= 50) u ON u.source = b.source AND u.token = b.token""")(lambda r: blocking.token_pairs(r, CAP))
J3 = """SELECT a.entity_id AS s1, b.entity_id AS cand, b.source AS cand_source, sum(ln(1e6 / (freq + 1))) AS score FROM post a JOIN post b ON a.source = 1 AND b.source > 1 AND a.token = b.token AND a.country = b.country JOIN use23 u ON u.token = a.token GROUP BY ALL"""
on_records("j3_scored_pairs", f"SELECT s1, cand, cand_source, round(score, 6) AS score FROM ({J3})")(lambda r: rounded(blocking.scored_pairs(r, CAP), "score"))
RARE = "SELECT entity_id AS s1, country, token, freq FROM post JOIN use23 USING (token) WHERE source = 1 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY freq, token) <= 4"
on_records("w1_rarest_tokens", RARE)(lambda r: blocking.rarest_tokens(r, CAP).drop("place"))
on_records("j4_rarest_token_blocking", f"SELECT DISTINCT q.s1, b.entity_id AS cand, b.source AS cand_source FROM ({RARE}) q JOIN post b ON b.source > 1 AND b.token = q.token AND b.country = q.country")(lambda r: blocking.rarest_token_pairs(r, CAP))
on_records("j5_shared_counts", "SELECT * FROM nshared")(lambda r: blocking.shared_counts(r, CAP, "strict"))
on_records("j5_top_k_blocking", "SELECT * FROM pair")(fixture.pairs)
on_records("j5_wildcard_country", "SELECT a.entity_id AS s1, b.entity_id AS cand, b.source AS cand_source, count(*) AS n_shared FROM npost a JOIN npost b ON a.source = 1 AND b.source > 1 AND a.token = b.token AND (a.country = b.country OR a.country = '' OR b.country = '') GROUP BY ALL")(lambda r: blocking.shared_counts(r, CAP))
on_records("j7_anti_join", "SELECT p.s1, p.cand, p.cand_source FROM pair p WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1 = p.s1 AND t.cand = p.cand)")(lambda r: blocking.without(fixture.pairs(r), fixture.truth(r)).select("s1", "cand", "cand_source"))
on_records("j8_semi_join", "SELECT * FROM pair WHERE s1 IN (SELECT s1 FROM truth)")(lambda r: blocking.within(fixture.pairs(r), fixture.truth(r)))
on_records("j9_left_join_text", "SELECT s1, cand, cand_source, s1_name, s1_addr, s1_country, c_name, c_addr, c_country FROM ptext")(lambda r: blocking.with_text(fixture.pairs(r), r))
on_records("j10_inner_join_text", "SELECT s1, cand, cand_source, s1_name, s1_addr, s1_country, c_name, c_addr, c_country FROM ptext WHERE cand_source = 2 UNION ALL SELECT s1, cand, cand_source, s1_name, s1_addr, s1_country, c_name, c_addr, c_country FROM ptext WHERE cand_source = 3")(
    lambda r: blocking.with_text(fixture.pairs(r).where("cand_source = 2"), r, "inner").unionByName(blocking.with_text(fixture.pairs(r).where("cand_source = 3"), r, "inner")))
on_records("j11_token_weights", "SELECT entity_id, token, round(ln(1e6 / (freq + 1)), 6) AS w FROM post JOIN use23 USING (token)")(
    lambda r: stats.postings(r).join(stats.frequency(stats.postings(blocking.candidates_of(r)), cap=CAP), "token").select("entity_id", "token", F.round(stats.log_weight(), 6).alias("w")))
on_records("j12_lateral_explode", "SELECT * FROM post")(stats.postings)
on_records("j13_lookup_by_id", "SELECT t.s1, t.cand, r.name AS c_name FROM truth t JOIN rec r ON r.entity_id = t.cand")(
    lambda r: fixture.truth(r).join(r.select(F.col("entity_id").alias("cand"), F.col("name").alias("c_name")), "cand").select("s1", "cand", "c_name"))

# Aggregates

on_records("a1_frequency_by_source", "SELECT source, token, count(*) AS freq FROM post GROUP BY ALL")(lambda r: stats.frequency(stats.postings(r), "source"))
on_records("a2_frequency_candidates", "SELECT * FROM df23")(lambda r: stats.frequency(stats.postings(blocking.candidates_of(r))))
on_records("a3_frequency_pooled", "SELECT token, count(*) AS freq FROM post GROUP BY token")(lambda r: stats.frequency(stats.postings(r)))
on_records("a4_occurrences", "SELECT token, count(*) AS freq FROM occ WHERE source > 1 GROUP BY token")(lambda r: stats.frequency(stats.postings(blocking.candidates_of(r), distinct=False)))
on_records("a5_name_occurrences_capped", "SELECT token, count(*) AS freq FROM nocc WHERE source > 1 GROUP BY token HAVING count(*) <= 50")(lambda r: stats.frequency(stats.postings(blocking.candidates_of(r), ("name",), 1, False), cap=CAP))
on_records("a6_entities_capped", "SELECT token, count(DISTINCT entity_id) AS freq FROM occ GROUP BY token HAVING count(DISTINCT entity_id) <= 50")(lambda r: stats.frequency(stats.postings(r, distinct=False), cap=CAP, entities=True))
VOCAB = "SELECT token, 1 / log2(count(*) + 2) AS w FROM (SELECT unnest(list_filter(string_split({f}, ' '), lambda x: length(x) >= 2)) AS token FROM rec) GROUP BY token"
on_records("a7_vocabulary_weights", f"SELECT 'name' AS field, token, round(w, 6) AS w FROM ({VOCAB.format(f='name')}) UNION ALL SELECT 'addr', token, round(w, 6) FROM ({VOCAB.format(f='addr')})")(
    lambda r: rounded(stats.vocabulary_weights(r, "name").withColumn("field", F.lit("name")).unionByName(stats.vocabulary_weights(r, "addr").withColumn("field", F.lit("addr"))), "w"))
on_records("a8_local_weights", """, texts AS (SELECT unnest([s1_name, s1_addr, c_name, c_addr]) AS t FROM ptext),
counted AS (SELECT token, count(*) AS f FROM (SELECT unnest(list_distinct(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS token FROM texts) GROUP BY token)
SELECT token, round(ln(((SELECT count(*) FROM texts) + 1)::DOUBLE / (f + 1)), 6) AS w FROM counted""")(lambda r: rounded(stats.counted_weights(r, tally.by_record(k := fixture.keys(r), fixture.best(k))), "w"))
WEIGHTED = """, vocab AS ({v}), side AS (
  SELECT s1, cand, 'a' AS role, unnest({a}) AS token FROM ptok UNION ALL SELECT s1, cand, 'b', unnest({b}) FROM ptok UNION ALL SELECT s1, cand, 's', unnest(list_intersect({a}, {b})) FROM ptok),
sums AS (SELECT s1, cand, sum(w) FILTER (WHERE role = 'a') AS wa, sum(w) FILTER (WHERE role = 'b') AS wb, sum(w) FILTER (WHERE role = 's') AS ws FROM side JOIN vocab USING (token) GROUP BY ALL)
SELECT s1, cand, round(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE coalesce(ws, 0) / nullif(least(wa, wb), 0) END, 6) AS {f}_weighted_overlap FROM ptok LEFT JOIN sums USING (s1, cand)"""
for _f, _a, _b in (("name", "an", "bn"), ("addr", "aa", "ba")):
    on_records(f"a9_{_f}_weighted_overlap", WEIGHTED.format(v=VOCAB.format(f=_f), a=_a, b=_b, f=_f))(
        lambda r, f=_f: rounded(features.weighted_overlap(fixture.paired(r), ["s1", "cand"], f, stats.vocabulary_weights(r, f), records=r), f"{f}_weighted_overlap"))
on_records("a10_pair_statistics", "SELECT count(*) AS n_pairs, count(DISTINCT s1) AS n_queries, count(*) FILTER (WHERE cand_source = 2) AS n_source2, count(*) FILTER (WHERE cand_source = 3) AS n_source3 FROM pair")(
    lambda r: (c := fixture.counted(fixture.keys(r))).agg(metrics.number(c).alias("n_pairs"), F.countDistinct("s1").alias("n_queries"), *(metrics.number(c, F.col("cand_source") == s).alias(f"n_source{s}") for s in (2, 3))))
LISTS = "SELECT s1 AS source1_entity_id, coalesce(string_agg(cand, ',' ORDER BY {o}), '') AS {c} FROM ent LEFT JOIN {t} USING (s1) GROUP BY s1"
on_records("a11_candidate_lists", LISTS.format(o="cand", c="candidate_entity_ids", t="pair"))(lambda r: tally.lists(k := fixture.keys(r), fixture.best(k), "candidate_entity_ids"))
on_records("a11_result_lists", LISTS.format(o="probability DESC, cand", c="matched_entity_ids", t="(SELECT * FROM scored WHERE probability >= 0.5)"))(lambda r: fixture.result_lists(r, 0.5))
on_records("a12_truth_cardinality", "SELECT count(*) AS n_entities, count(*) FILTER (WHERE n = 0) AS n_singletons, sum(n)::BIGINT AS n_matches, max(n) AS max_matches, avg(n) AS mean_matches FROM (SELECT s1, count(cand) AS n FROM ent LEFT JOIN truth USING (s1) GROUP BY s1)")(lambda r: metrics.truth_cardinality(fixture.truth(r), fixture.entities(r)))
on_records("a13_blocking_recall", """, f AS (SELECT count(*) AS n_true, count(*) FILTER (WHERE p.s1 IS NOT NULL) AS n_found FROM truth t LEFT JOIN (SELECT s1, cand FROM pair) p USING (s1, cand))
SELECT n_true, n_found, n_pairs, n_entities, coalesce(n_found::DOUBLE / nullif(n_true, 0), 0) AS recall, n_pairs::DOUBLE / n_entities AS mean_candidates FROM f, (SELECT count(*) AS n_pairs FROM pair), (SELECT count(*) AS n_entities FROM ent)""")(lambda r: metrics.recall_of_counts(fixture.counted(k := fixture.keys(r)), tally.true_pairs(k), fixture.entities(k)))
on_records("a14_candidate_counts", "SELECT avg(n) AS mean_candidates, median(n) AS median_candidates, max(n) AS max_candidates FROM (SELECT s1, count(cand) AS n FROM ent LEFT JOIN pair USING (s1) GROUP BY s1)")(lambda r: metrics.candidate_counts(fixture.counted(k := fixture.keys(r)), fixture.entities(k)))

STAGE1 = f"""SELECT s1, cand, cand_source, round(sum(points), 9) AS stage1 FROM (SELECT s1, cand, cand_source, score AS points FROM ({J3})
UNION ALL SELECT s1, cand, e.cand_source, 30 FROM exname e JOIN rec a ON a.entity_id = s1 JOIN rec b ON b.entity_id = cand AND a.country = b.country
UNION ALL SELECT s1, cand, e.cand_source, 20 FROM exaddr e JOIN rec a ON a.entity_id = s1 JOIN rec b ON b.entity_id = cand AND a.country = b.country) GROUP BY ALL"""
on_records("w3_first_stage", f"SELECT s1, cand, cand_source, round(stage1, 6) AS stage1 FROM ({STAGE1})")(lambda r: rounded(ranking.first_stage(r, CAP), "stage1"))
on_records("w2_top_by_source", "SELECT s1, cand, cand_source, n_shared FROM nbest")(lambda r: blocking.top_k(blocking.shared_counts(r, CAP, "strict"), TOP, "n_shared", "s1", "cand_source").drop("place"))
RANKED = f""", st1 AS MATERIALIZED ({STAGE1}), kept AS (SELECT * FROM st1 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY stage1 DESC, cand) <= 300),
rtok AS MATERIALIZED (SELECT entity_id, name, addr, list_distinct(list_filter(string_split(name, ' ') || string_split(addr, ' '), lambda x: length(x) >= 2)) AS t,
  list_distinct(list_filter(string_split(name, ' '), lambda x: length(x) >= 2)) AS n, list_distinct(list_filter(string_split(addr, ' '), lambda x: length(x) >= 2)) AS u, list_distinct(regexp_extract_all(whole, '[0-9]+')) AS x FROM rec),
rt AS (SELECT k.*, a.name AS an, a.addr AS aa, b.name AS bn, b.addr AS ba, a.t AS ta, b.n AS tb, a.u AS ua, b.u AS ub, a.x AS xa, b.x AS xb FROM kept k JOIN rtok a ON a.entity_id = s1 JOIN rtok b ON b.entity_id = cand),
st2 AS (SELECT s1, cand, cand_source, stage1, round(stage1 + 25 * (an = bn AND an <> '')::INT + 15 * (aa = ba AND aa <> '')::INT
  + 8 * coalesce(len(list_intersect(ta, tb))::DOUBLE / nullif((len(ta) + len(tb) - len(list_intersect(ta, tb))), 0), 0) + 5 * coalesce(len(list_intersect(ta, tb))::DOUBLE / nullif(least(len(ta), len(tb)), 0), 0)
  + 4 * coalesce(len(list_intersect(ua, ub))::DOUBLE / nullif((len(ua) + len(ub) - len(list_intersect(ua, ub))), 0), 0) + 4 * coalesce(len(list_intersect(xa, xb))::DOUBLE / nullif(least(len(xa), len(xb)), 0), 0), 9) AS stage2 FROM rt)"""
on_records("w4_two_stage_ranking", RANKED + "SELECT s1, cand, cand_source, round(stage1, 4) AS stage1, round(stage2, 4) AS stage2 FROM st2")(lambda r: ranking.rank(r, CAP).select("s1", "cand", "cand_source", F.round("stage1", 4).alias("stage1"), F.round("stage2", 4).alias("stage2")))
on_records("a15_recall_at_k", RANKED + """, pl AS (SELECT s1, cand, row_number() OVER (PARTITION BY s1 ORDER BY stage2 DESC, cand) AS place FROM st2),
j AS (SELECT place FROM truth LEFT JOIN pl USING (s1, cand)) SELECT k, (SELECT count(*) FROM j WHERE place <= k) AS found, (SELECT count(*) FROM j) AS total, coalesce((SELECT count(*) FROM j WHERE place <= k)::DOUBLE / nullif((SELECT count(*) FROM j), 0), 0) AS recall FROM (VALUES (25), (50), (100), (200), (500)) v(k)""")(lambda r: ranking.recall_of_best(ranking.rank(r, CAP), tally.true_pairs(fixture.keys(r))))

COUNTS = "count(*) FILTER (WHERE label = 1 AND probability >= {t}) AS tp, count(*) FILTER (WHERE label = 0 AND probability >= {t}) AS fp, count(*) FILTER (WHERE label = 1 AND probability < {t}) AS fn"
_p, _r, _f = _f05()
on_records("a16_pair_metrics", f"SELECT tp, fp, fn, {_p} AS precision, {_r} AS recall, {_f} AS f05 FROM (SELECT {COUNTS.format(t=0.5)} FROM scored)")(lambda r: metrics.pair_metrics(fixture.tallied(r, fixture.keys(r), [0.5]), 0.5))
on_records("a17_entity_macro", f"SELECT round(avg({_f}), 6) AS macro_f05, count(*) AS n_entities FROM (SELECT s1, {COUNTS.format(t=0.5)} FROM scored GROUP BY s1)")(lambda r: rounded(metrics.entity_macro(fixture.tallied(r, fixture.keys(r), [0.5]), 0.5), "macro_f05"))
on_records("a18_official_metric", f""", per AS (SELECT s1, count(*) FILTER (WHERE p.cand IS NOT NULL AND t.cand IS NOT NULL) AS tp, count(*) FILTER (WHERE p.cand IS NOT NULL AND t.cand IS NULL) AS fp, count(*) FILTER (WHERE p.cand IS NULL) AS fn
  FROM (SELECT s1, cand FROM scored WHERE probability >= 0.5) p FULL JOIN truth t USING (s1, cand) GROUP BY s1),
e AS (SELECT s1, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM ent LEFT JOIN per USING (s1))
SELECT round(avg(CASE WHEN tp + fn = 0 THEN (fp = 0)::INT ELSE {_f} END), 6) AS macro_f05, count(*) FILTER (WHERE tp + fn = 0) AS n_singletons, count(*) AS n_entities FROM e""")(lambda r: rounded(metrics.official_of_counts(fixture.tallied(r, k := fixture.keys(r), [0.5]).where("probability >= 0.5"), tally.true_counts(k)), "macro_f05"))
SWEEP = f"SELECT threshold, tp, fp, fn, {_p} AS precision, {_r} AS recall, {_f} AS f05 FROM (SELECT threshold, {COUNTS.format(t='threshold')} FROM scored, (SELECT i / 100.0::DOUBLE AS threshold FROM range(10, 95, 2) r(i)) GROUP BY threshold)"
on_records("a19_pair_sweep", SWEEP)(lambda r: metrics.sweep(fixture.tallied(r, fixture.keys(r), metrics.PAIR_SWEEP)))
on_records("a19_best_threshold", f"SELECT * FROM ({SWEEP}) ORDER BY f05 DESC, threshold LIMIT 1")(lambda r: metrics.best(metrics.sweep(fixture.tallied(r, fixture.keys(r), metrics.PAIR_SWEEP)), "f05"))
on_records("a19_entity_sweep", f"SELECT threshold, round(avg({_f}), 6) AS macro_f05 FROM (SELECT threshold, s1, {COUNTS.format(t='threshold')} FROM scored, (SELECT i / 100.0::DOUBLE AS threshold FROM range(50, 96) r(i)) GROUP BY threshold, s1) GROUP BY threshold")(lambda r: rounded(metrics.entity_sweep(fixture.tallied(r, fixture.keys(r), metrics.ENTITY_SWEEP)), "macro_f05"))
on_records("a20_class_balance", "SELECT sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, coalesce(sum(1 - label)::DOUBLE / nullif(sum(label), 0), 1) AS scale_pos_weight FROM scored")(lambda r: metrics.class_balance(fixture.counted(fixture.keys(r))))
on_records("a21_feature_summary", "SELECT feature, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max FROM (UNPIVOT (SELECT name_exact, name_token_jaccard, addr_token_overlap FROM feat) ON name_exact, name_token_jaccard, addr_token_overlap INTO NAME feature VALUE x) GROUP BY feature")(
    lambda r: rounded(metrics.summary(fixture.summed(r, fixture.keys(r)), ["name_exact", "name_token_jaccard", "addr_token_overlap"]), "mean"))

# Order, limits, sets

on_records("l1_order_by", "SELECT entity_id, country, name FROM rec ORDER BY country DESC, name, entity_id")(lambda r: r.select("entity_id", "country", "name").orderBy(F.desc("country"), "name", "entity_id"))
on_records("l3_head_sample", "SELECT DISTINCT s1 FROM truth ORDER BY s1 LIMIT 10")(lambda r: pairs.head(fixture.truth(r).select("s1").distinct(), 10))
on_records("l4_entity_split")(lambda r: pairs.split(fixture.pairs(r)))
on_records("l5_shuffle")(lambda r: pairs.shuffled(fixture.pairs(r)))
on_records("u1_union_all", "SELECT s1, cand FROM exname UNION ALL SELECT s1, cand FROM exaddr")(lambda r: blocking.exact(r, "name").unionByName(blocking.exact(r, "addr")).select("s1", "cand"))
on_records("u3_distinct_subset", "SELECT DISTINCT country, token FROM post")(lambda r: stats.postings(r).dropDuplicates(["country", "token"]).select("country", "token"))
on_records("u4_set_operations", "SELECT 'both' AS part, s1, cand FROM pair JOIN (SELECT s1, cand FROM truth) USING (s1, cand) UNION ALL SELECT 'missed', s1, cand FROM (SELECT s1, cand FROM truth EXCEPT SELECT s1, cand FROM pair)")(
    lambda r: fixture.truth(r).select("s1", "cand").join(fixture.pairs(r), ["s1", "cand"], "left").select(F.when(F.col("cand_source").isNotNull(), "both").otherwise("missed").alias("part"), "s1", "cand"))

# Features

TOKEN_NAMES = [n for n in features.NAMES if "char_sim" not in n and "weighted" not in n and n != "digit_similarity"]
on_records("g_serve_token_features", f"SELECT s1, cand, {', '.join(f'round({n}, 6) AS {n}' for n in TOKEN_NAMES)} FROM feat")(
    lambda r: features.listed_token_features(fixture.paired(w := fixture.written(r)), ["s1", "cand"], w, TOKEN_NAMES, 6))
on_records("g_serve_features")(lambda r: features.features(fixture.paired(w := fixture.written(r)), ["s1", "cand", "cand_source"], w))
on_records("g_train_features")(lambda r: features.features(fixture.truth(r), ["s1", "cand", "cand_source"], r, "train"))
on_records("g_legacy_features")(lambda r: features.legacy(fixture.paired(w := fixture.written(r)), ["s1", "cand"], w))
on_records("u_indel_ratio")(lambda r: rounded(blocking.with_text(fixture.pairs(r), r).select("s1", "cand", sim.indel_ratio("s1_name", "c_name").alias("name_char_sim")), "name_char_sim"))
on_records("u_digit_similarity")(
    lambda r: fixture.paired(r)(r.select("entity_id", text.digits_only("addr").alias("digits"))).select("s1", "cand", F.col("_s1_made.digits").alias("a"), F.col("_c_made.digits").alias("b")).select("s1", "cand", sim.unless_equal(sim.indel_ratio_empty, "a", "b", 1.0).alias("digit_similarity")))

# Training pairs and models

on_records("t1_parse_truth", "SELECT s1, cand FROM truth")(lambda r: pairs.parse_truth(fixture.truth_table(r)))
on_records("t2_positives", "SELECT s1, cand, cand_source, 1 AS label FROM truth")(lambda r: pairs.positives(fixture.truth(r), r))
NEGATIVES = """, u AS (SELECT token, count(*) AS freq FROM post GROUP BY token HAVING count(*) <= 50),
q AS (SELECT entity_id AS s1, country, token, freq FROM post JOIN u USING (token) WHERE source = 1 AND entity_id IN (SELECT s1 FROM truth) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY freq, token) <= 4),
n AS (SELECT q.s1, b.entity_id AS cand, b.source AS cand_source, round(sum(1.0::DOUBLE / (1 + freq)), 9) AS score FROM q JOIN post b ON b.source > 1 AND b.token = q.token AND b.country = q.country
      WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1 = q.s1 AND t.cand = b.entity_id) GROUP BY ALL)
SELECT s1, cand, cand_source, 0 AS label FROM n QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) <= 8"""
on_records("t3_hard_negatives", NEGATIVES)(lambda r: pairs.hard_negatives(fixture.truth(r), r, CAP))


def _training(r: DataFrame) -> DataFrame:
    labelled = pairs.split(pairs.training_pairs(fixture.truth(r), r, CAP))
    return files.kept(features.features(labelled, ["s1", "cand", "cand_source", "label", "is_train"], r), "training")  # fitting reads it many times


@on_records("m1_logistic_regression")
def _(r):
    data = _training(r)
    fitted = model.fit_logistic(data.where("is_train"), features.NAMES)
    return model.score(fitted, data).select("s1", "cand", "label", "probability", "predicted")


@on_records("m3_boosted_trees")
def _(r):
    data = _training(r)
    fitted = model.fit_trees(data.where("is_train"))
    return model.score(fitted, data).select("s1", "cand", "label", "probability", "predicted")


@query("k_validate_lists", "SELECT 'K6_missing' AS rule, 'error' AS severity, s1 AS item FROM ent WHERE s1 NOT IN (SELECT s1 FROM pair)")
def _(spark, sf_dir):
    r = fixture.records(spark, sf_dir)
    lists = output.id_lists(fixture.pairs(r), fixture.pairs(r).select("s1"), "candidate_entity_ids")
    body = lists.select(F.concat_ws("\t", "source1_entity_id", "candidate_entity_ids").alias("value"), F.lit(1).alias("place"))
    lines = spark.createDataFrame([(validate.HEADERS["candidate_entity_ids"], 0)], "value string, place int").unionByName(body)
    return validate.issues(lines, "candidate_entity_ids", fixture.entities(r), blocking.candidates_of(r).select(F.col("entity_id").alias("cand")))


on_records("k7_outside_candidates", "SELECT 'K7_not_a_candidate' AS rule, 'warning' AS severity, t.s1 || ' ' || t.cand AS item FROM truth t WHERE NOT EXISTS (SELECT 1 FROM nbest p WHERE p.s1 = t.s1 AND p.cand = t.cand)")(
    lambda r: validate.outside_candidates(fixture.truth(r).select("s1", "cand"), blocking.top_k(blocking.shared_counts(r, CAP, "strict"), TOP, "n_shared", "s1", "cand_source").select("s1", "cand")))
