"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each opN query takes its table through its operator and derives the columns that the query
promises from what the operator returns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document, by the base rule and rules learned from labels."""
    from .quality_rules import apply_rules, labelled, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(labelled(docs, table(spark, sf_dir, "labels"), "text", "doc_id", "quality"))
    m = F.col("measures")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return apply_rules(docs, rules).select("doc_id", *[m[c].alias(c) for c in names], "base_failed", "kept")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's set of 5-word n-grams, and the component it is linked to."""
    from .ngram_join import components

    return components(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    from .byte_bpe import ByteBpe, codec, id_lists

    bpe = ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, pattern = bpe.handle(docs), bpe.pattern

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model.value, pattern)
        decimal = list(map(str, range(len(own.tokens))))
        for ids in parts:
            n, of_ids, of_bytes = [], [], []
            for row in id_lists(ids):
                n.append(len(row))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, row)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(row)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return bpe.encode(docs).select("doc_id", digests("ids").alias("d")).select("doc_id", "d.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in the order in which they are served."""
    from .mixing import mix, n_words, served_order

    sizes = saved(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return served_order(mix(sizes)).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "finish")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every vector whose id is divisible by 100."""
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a network that learns from the rows not held out."""
    from .mil_classifier import fit, held_out, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    out = scored(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all of them."""
    from .pseudo_lm import learn, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, learn(docs)).select("doc_id", "lm.*")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, linked by quotation, in reply order, without quotes."""
    from .chat import formatted

    return formatted(table(spark, sf_dir, "conversations"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids to shard files and reads them back."""
    import public_tokenizers
    from pyspark.sql import Window

    from .token_files import write_tokens

    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

    read = files.read().select("key", "shard", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    read = saved(read, "token-digests")
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return read.join(before, "shard").select(F.col("key").alias("doc_id"), (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record for every page and reads the archives back."""
    from .warc import write_archives

    read = write_archives(table(spark, sf_dir, "pages")).read()
    return read.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for each benchmark item."""
    from .lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the first components of all of them, at unit variance."""
    from .whitening import fit, whitened

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitened(vectors, fit(vectors))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by the nearest examples of the rows not held out."""
    from .mil_classifier import held_out
    from .toxicity import fit, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    out = scored(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.evidence")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


ORACLE_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""

# The pattern of a term and the folding of A-Z, as in lexical.FOLD.
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {TERMS} AS a FROM documents WHERE text IS NOT NULL),
t AS (SELECT k, doc_id, unnest(a) AS term FROM d),
f AS (SELECT k, doc_id, term, count(*) AS tf FROM t GROUP BY k, doc_id, term),
c AS (SELECT count(*) AS docs, CAST(sum(len(a)) AS BIGINT) AS terms FROM d WHERE len(a) > 0),
m AS (SELECT k, 50 + (50 * len(a) * docs) // terms AS m FROM d, c WHERE len(a) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY item_id, k, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mixing": op4_mixing,
    "op5_neighbours": op5_neighbours,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pseudo_lm": op7_pseudo_lm,
    "op8_chat": op8_chat,
    "op9_token_files": op9_token_files,
    "op10_warc": op10_warc,
    "op11_lexical": op11_lexical,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}
ORACLES: dict[str, str] = {"op10_warc": ORACLE_OP10, "op11_lexical": ORACLE_OP11}
