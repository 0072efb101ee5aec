"""Queries over the operators of this folder, with the parameters of production, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90).drop("row").withColumnRenamed("id", "doc_id")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of all documents by the law `rows`, along source, language, size and id."""
    from .shard import bits_for, listed_dimension, scaled_dimension, shards

    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(body) + 8).cast("long"), F.crc32(body.cast("binary"))
    total, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    bits = bits_for(total, 4)
    known = {c: [r[0] for r in docs.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1 << bits).collect()] for c in ("source", "lang")}
    scale = scaled_dimension(F.log2(size), 3, 24, bits)
    row = F.struct("doc_id", size.alias("size"), crc.alias("text_crc32"))
    cut = shards(row, [*(listed_dimension(F.col(c), known[c], bits) for c in known), scale, scaled_dimension(F.col("doc_id"), low, high, bits)], F.col("doc_id"), 24, docs, bits)
    return cut.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items they hold."""
    from .decontam import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", "coverage")


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_pstable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pack import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op7_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    from .chat import digests, format_conversations

    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    part = F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return digests(format_conversations(turns.withColumn("parts", F.array(part))))


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    from .oracles import oracle_sql as known

    return known()
