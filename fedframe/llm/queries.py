"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import chat, common, langid, minhash, mixing, quality, secret_scan, sentencepiece_codec, sharding, simhash, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the public tokenizers' file of that name is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base kinds, and all spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["order"] < len(secret_scan.BASE_RULES))
    of_kind = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[of_kind(r.kind) for r in secret_scan.BASE_RULES], F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Encode and decode every document; digests of ids and decoded text, and the bytes that the spans cover."""
    model = model or tokenizer("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model, decoded=True)
    listed = F.replace(F.btrim(F.col("ids").cast("string"), F.lit("[]")), F.lit(", "), F.lit(","))  # "[1, 2]" is one string, not one for each id
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes_covered"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one of control strings, and read turns and loss back from the output."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(rows.unionByName(extra))
    # One more projection, as the parts are used twice.
    parts = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    return parts.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Count every document, apply three edits to it (a word replaced at a third, one put in at two thirds, the
    last ten characters taken out) and bring the count up to date; n_encoded is what that encoded again."""
    import public_tokenizers

    path, pattern = path or tokenizer("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.count(docs, path, pattern, keep=("doc_id", "text"))
    n, by = F.length("text"), F.concat(F.lit(" edit"), F.col("doc_id").cast("string"))
    edit = lambda start, stop, put: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), put.alias("put"))
    edits = F.array(edit(F.floor(n / 3), F.floor(n / 3) + 6, by), edit(F.floor(2 * n / 3), F.floor(2 * n / 3), F.lit("ed.\n new")), edit(n - 10, n, F.lit("")))
    ready = counted.select(F.struct("doc_id", F.col("n_tokens").alias("before")).alias("facts"), "text", "leaf_chars", "leaf_tokens", edits.alias("edits"))
    after = token_counts.recount(ready, path, pattern, keep=("facts",))
    return after.select("facts.doc_id", F.col("facts.before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.sha2("text", 256).alias("edited_sha256"), F.size("leaf_chars").cast("long").alias("n_leaves_edited"), "n_encoded")


def op5_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """Append all documents as small shards in several arrivals, compact them and read the last version back.

    A document arrives with those that a hash of its id puts beside it; together
    the arrivals are the whole table. For each document: a digest of its text, how
    many rows the store has of it, whether its shard is as the manifest says and of
    at most the target size, and whether compaction left fewer shards.
    """
    docs, store = _table(spark, sf_dir, "documents"), sharding.ShardStore(spark, common.scratch_path(spark, "shards"))
    turn = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0))
    for k in range(arrivals):
        store.append(docs.where(turn == k))
    appended = store.manifest().shards
    store.compact()
    store.vacuum(grace_seconds=0)  # no one else writes here
    rows = store.read(shard_col="__shard").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("__shard").alias("shard"))
    facts = store.shards()
    found = rows.groupBy("shard").agg(F.count("*").alias("found")).join(facts, "shard")
    good = found.select("shard", ((F.col("found") == F.col("rows")) & (F.col("bytes") <= store.target)).alias("shard_ok"))
    copies = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n_copies"), F.min("shard").alias("shard"))
    compacted = F.lit(store.manifest().shards < appended)
    return copies.join(good, "shard", "left").select("doc_id", "text_sha256", "n_copies", F.coalesce("shard_ok", F.lit(False)).alias("shard_ok"), compacted.alias("compacted"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five words, similarity 0.75."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are.

    For documents whose id is divisible by 20, searched among all, and null for the
    rest: n_near, the other documents within three bits; near_classes, their
    fingerprints but for its own, joined by commas (the rows that have one are its
    members).
    """
    prints = simhash.materialise(simhash.compare_edits(_table(spark, sf_dir, "documents")), "compared")
    rows, asks = prints.select(F.col("own").alias("fingerprint")), F.coalesce(F.col("id") % 20 == 0, F.lit(False))
    asked = prints.where(asks)
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    near = simhash.search(rows, asked.select(F.col("own").alias("fingerprint")), own=True)
    other = F.when(F.col("fingerprint") != F.col("query"), text("fingerprint"))
    near = near.groupBy("query").agg((F.sum("n") - 1).alias("n_near"), F.array_join(F.sort_array(F.collect_list(other)), ",").alias("near_classes"))
    found = asked.join(near, F.col("own") == F.col("query")).select(*prints.columns, "n_near", "near_classes")
    out = found.union(prints.where(~asks).select("*", F.lit(None).cast("long"), F.lit(None).cast("string")))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"), "near_edited", "near_next", "n_near", "near_classes")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights 5, 2, 1."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    vocabulary = vocabulary or tokenizer("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()), vocabulary)
    found = langid.identify(docs.select("doc_id", "text"), model, vocabulary)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document, with cutoffs certified per language on labelled good documents."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": op1_secrets,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_chat": op3_chat,
        "op4_token_counts": op4_token_counts,
        "op5_sharding": op5_sharding,
        "op6_minhash": op6_minhash,
        "op7_simhash": op7_simhash,
        "op8_mixing": op8_mixing,
        "op9_langid": op9_langid,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": secret_scan.secrets_sql(),
        "op3_chat": chat.CHAT_SQL,
        "op5_sharding": """SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, count(*) AS n_copies, true AS shard_ok, true AS compacted
            FROM documents GROUP BY ALL""",
        "op6_minhash": minhash.NEAR_SQL,
        "op8_mixing": mixing.MIX_SQL,
        "op10_quality": quality.quality_sql(),
    }
