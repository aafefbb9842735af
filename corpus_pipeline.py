"""A corpus pipeline: documents through five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. A stage learns, counts and decides on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.byte_bpe import ByteBpe
from symloom.llm.mil_classifier import fit, held_out, scored
from symloom.llm.mixing import mix, n_words
from symloom.llm.ngram_join import components
from symloom.llm.quality_rules import apply_rules, labelled, learn
from symloom.llm.shared import free_name, saved


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    rules = learn(labelled(docs, labels_of(spark, sf_dir), "text", "doc_id", "quality"))
    kept = apply_rules(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), rules).filter("kept")
    return kept.select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.3 go."""
    net = fit(docs, labels_of(spark, sf_dir).filter(~held_out(F.col("doc_id"))))
    score = free_name(docs, "score")
    return scored(docs, net, to=score).filter(F.col(score) >= 0.3).drop(score)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows that repeat
    id and text are one document."""
    stay = components(docs).filter("doc_id <=> component_id").select("doc_id").distinct()
    key = free_name(docs, "stays")
    stay = stay.withColumnRenamed("doc_id", key)
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col(key)), "left_semi").dropDuplicates(["doc_id", "text"])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it as a whole: not at all, once or twice."""
    size = free_name(docs, "size")
    mixed = mix(docs.withColumn(size, n_words(F.col("text"))), size=size)
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and ids of each row; decoded_ok: the ids decode to the text."""
    import public_tokenizers

    bpe = ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.round_trip(docs.select("doc_id", "source", "text")).select("doc_id", "source", "text", "round_trip.*")
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decoded_ok"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Learned stages and tokenization are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
