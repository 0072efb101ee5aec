"""From raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import row_key, table, without, written
from textloom.llm.decontam import clean
from textloom.llm.jaccard import jaccard_groups
from textloom.llm.pack import pack
from textloom.llm.pii import masked
from textloom.llm.quality import accepted

ORACLE_SQL = None  # the stages train models, tokenise and follow links


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score reaches the threshold, unchanged, in whatever columns they come.

    Null and empty texts are scored like others; equal and repeated rows share one score; an empty table stays empty.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 hold together, the one of least id; equal rows go as one.

    A document without an id stays unless it is a copy of one that has an id. Texts without words stay. Of rows of one
    id and text whose other columns differ, the one whose JSON comes first stays. Extra columns may have any names; an
    empty table stays empty.
    """
    groups = written(jaccard_groups(docs, k=5, num=80, den=100), "groups")
    rows = groups.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.bool_or(~F.expr("id <=> component_id")).alias("gone"))
    odd = written(rows.where("gone OR copies > 1").select(F.col("row").alias("key"), "copies", "gone"), "odd")

    def once(met: DataFrame) -> DataFrame:
        known = met.join(odd, "key", "left").where("NOT coalesce(gone, false)")
        several = known.where("copies > 1").groupBy("key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        return known.where("coalesce(copies, 1) = 1").select("doc").unionByName(several.select("doc"))

    return without(docs, row_key("doc_id", "text"), odd.select("key"), once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, unchanged; null, empty and repeated rows stay, in whatever columns they come."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars brought up to date.

    Null and empty texts stay as they are, and so do all other columns; n_chars of a null text is null.
    """
    out = masked(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids; null and empty texts are one id long, an empty table gives no rows."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
