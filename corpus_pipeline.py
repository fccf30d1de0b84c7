"""A corpus, from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again before the next stage. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedframe.llm import langid, minhash, mixing, secret_scan, sentencepiece_codec
from fedframe.llm.common import materialise
from fedframe.llm.queries import tokenizer
from fedframe.shipping import ship

#: Below this share of the probability a language is not believed. With every letter
#: evidence, only texts of a few letters that suit several languages come near it.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter or a believable language go; lang becomes the prediction."""
    ship(spark)
    vocabulary = tokenizer("piece_bpe_32k.model")
    model = langid.train(docs.where(~langid.held_out()), vocabulary)
    found = langid.identify(docs, model, vocabulary, keep=tuple(docs.columns))
    believed = (F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= LEAST_SCORE)
    return found.where(believed).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each component one row stays, of the smallest id.

    Rows that repeat id and text are one document, of which any row stays, also
    where ids are null. A row goes if its own text's verdict says so, whatever
    other rows of its id do.
    """
    ship(spark)
    kept = materialise(minhash.survivors(docs).withColumnsRenamed({"id": "__id", "digest": "__digest"}), "kept")
    digest = F.sha2("text", 256)

    def of(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & digest.eqNullSafe(F.col("__digest")), "left_semi")

    out, repeated = of(kept.where("copies = 1")), kept.where("copies > 1")
    return out if repeated.isEmpty() else out.union(of(repeated).dropDuplicates(["doc_id", "text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every finding is masked in its text, and n_chars follows; no document goes."""
    found = secret_scan.scan(docs).where(F.size("spans") > 0).select("blob", "spans").groupBy("blob").agg(F.any_value("spans").alias("spans"))
    found = materialise(found, "found")
    blob = F.sha2(F.coalesce("text", F.lit("")), 256)
    hit = docs.withColumn("__blob", blob).join(found.withColumnRenamed("blob", "__found").hint("shuffle_hash"), F.col("__blob") == F.col("__found"), "left")
    text = F.when(F.col("spans").isNotNull(), secret_scan.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = hit.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it, the one at a source's edge whole."""
    taken = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("taken_id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    taken = taken.groupBy("taken_id").agg(F.max("copies").alias("copies"))
    out = docs.join(taken.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the ids of every document, and whether they decode to its text."""
    ship(spark)
    model = tokenizer("piece_bpe_32k.model")
    named = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    coded = sentencepiece_codec.encode(named, model, keep=("lang", "source", "digest"), decoded=True)
    same = F.sha2("decoded", 256) == F.col("digest")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

#: The language model and hash signatures have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
