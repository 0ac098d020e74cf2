"""Documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, jaccard, lines, mixing, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects.

    Null and empty texts are short and go; equal rows get equal verdicts; columns of any name stay
    as they are; an empty table stays empty."""
    own = common.fresh(docs, "rejected_by")
    return quality.cascade(docs, name=own).where(F.col(own).isNull()).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that occur, nearly or exactly, earlier in the corpus.

    Null text stays null; rows without doc_id come first; rows that repeat both id and text count as
    one document; n_chars is that of the new text, other columns stay; an empty table stays empty."""
    return lines.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates.

    Texts without a word link with nothing and stay.  A row without doc_id is numbered by its text,
    after all ids (62nd bit set), and of such rows with one text one stays; rows that repeat a
    doc_id stay or go together; columns of any name stay; an empty table stays empty."""
    unnamed = F.xxhash64("row.text").bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", F.coalesce(F.col("row.doc_id").cast("long"), unnamed).alias("id"))
    kept = jaccard.cluster(rows.select(F.col("id").alias("doc_id"), "row.text")).where("doc_id = component_id").select("doc_id").distinct()
    first = rows.join(kept, rows["id"] == kept["doc_id"], "left_semi")
    if not docs.where("doc_id IS NULL").isEmpty():
        first = first.where("row.doc_id IS NOT NULL").unionByName(first.where("row.doc_id IS NULL").dropDuplicates(["id"]))
    return first.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; see ``mixing.draw``."""
    return mixing.draw(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 1024 tokens.

    Null and empty texts are the end token alone; repeated rows are packed each; other columns are
    left out; an empty table stays empty."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", packing_stage),
]

#: The rounds of the near-duplicate join and the tokenizer are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
