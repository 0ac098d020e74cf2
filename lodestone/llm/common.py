"""What the operators share: the folder all executors see, tables that cut lineage, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space and the controls 9 to 13.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

#: Spark's setting that removes the shuffle files of a statement when it ends.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found or _own_dir.setdefault("path", tempfile.mkdtemp(prefix="lodestone-shared-"))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: lineage ends here,
    so a lost executor costs one read instead of a chain of stages.  The shuffle files behind the
    table go when it is written; nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_, name__, ... that is no column of ``df``."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))
