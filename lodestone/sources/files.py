"""Sources and sinks: TSV, CSV, Parquet and JSON, with the schemas of the linkage tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

strings = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
SOURCE = strings("entity_id", "business_name", "business_address", "country")
TRUTH = strings("source1_entity_id", "matched_entity_ids")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """``df`` written to a new path and read back.  ``settings`` of the session, with _ for each dot,
    hold while it is; its shuffle files go then."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    settings = {k.replace("_", "."): v for k, v in settings.items()} | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def read_source(spark: SparkSession, path: str | list[str], schema: T.StructType = SOURCE, na_strings: Iterable[str] = ()) -> DataFrame:
    """A TSV with header.  Quotes are text like any other, and so are NA, None and the like unless
    ``na_strings`` names them."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    na = [*na_strings]
    return df.select(*(F.when(~F.col(c).isin(na), F.col(c)).alias(c) for c in df.columns)) if na else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One file, several, or a glob."""
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, single: bool = False, mode: str = "overwrite") -> None:
    """CSV or TSV; a TSV is unquoted and its empty fields are truly empty.  ``single`` makes one
    file, with a header even if there is no row."""
    out = (df.coalesce(1) if single else df).write.mode(mode).option("header", header).option("sep", sep)
    if sep == "\t":
        out = out.option("quote", "").option("emptyValue", "").option("nullValue", "")
    out.csv(path)


def build_cache(spark: SparkSession, source: DataFrame, path: str, full_country: bool = False, rebuild: bool = False) -> DataFrame:
    """The normalised table of a source as Parquet, made only if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if rebuild or not there:
        write_parquet(normalize_source(source, full_country), path, "snappy")
    return spark.read.parquet(path)


def normalize_source(source: DataFrame, full_country: bool = False, nfkc: bool = False) -> DataFrame:
    return source.select("entity_id", text.normalize("business_name", nfkc).alias("name_norm"), text.normalize("business_address", nfkc).alias("addr_norm"), text.country("country", full_country).alias("country_norm"))


def write_threshold(path: str, threshold: float, **metrics) -> None:
    with open(path, "w") as f:
        json.dump({"threshold": threshold, **metrics}, f)


def read_threshold(path: str) -> float:
    with open(path) as f:
        found = json.load(f)
    for key in ("best_threshold", "threshold"):
        if key in found:
            return float(found[key])
    raise KeyError("no threshold in " + path)


def register(spark: SparkSession, name: str, rows: DataFrame | list, schema: str | None = None) -> DataFrame:
    """A DataFrame or literal rows as a view."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df


def describe(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column string, kind string")


def profile(df: DataFrame) -> DataFrame:
    """Rows, and per column those that are null or blank, in one pass."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in df.columns))
    return counts.unpivot(["n_rows"], [*df.columns], "column_name", "n_empty")
