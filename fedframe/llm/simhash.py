"""SimHash fingerprints and the search for near ones (DataFrame functions only).

Terms are a text's words and pairs of neighbouring words, each occurrence one
vote, a pair worth PAIR_WEIGHT. A term's 64-bit hash votes +weight on the bits it
has and -weight on the others; the fingerprint has the bits whose sum is positive.

Votes are counted without a shuffle. Four bits of a hash are spread over a long of
four 16-bit lanes, so that sixteen sums count all 64 bits at once; texts are
counted in blocks short enough for a lane, and blocks are then summed bit by bit.

The search cuts fingerprints into blocks: of those within the radius of each
other, some choice of blocks agrees wholly, so one table for each choice finds
them all by equality (every choice is a permutation that puts its blocks first).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_RUN, materialise, trimmed

BITS = 64
LANES = 4
PAIR_WEIGHT = 2
#: Words in a block: times PAIR_WEIGHT + 1 they are below 2**15, so that no lane, nor the sign, overflows.
BLOCK = 10_000
#: Keys sorted in a task, and ranges at most, so that a row of two keys for each can be broadcast.
ROWS_PER_RANGE = 20_000
MAX_RANGES = 65_536
_SPREAD = 1 | 1 << 15 | 1 << 30 | 1 << 45
_LANES = 1 | 1 << 16 | 1 << 32 | 1 << 48


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fingerprint (long) of each row; keys must name a row.

    Null and blank texts have no terms and the fingerprint 0. Equal texts have
    equal fingerprints. A text of one word votes with that word alone.
    """
    words = F.split(trimmed(F.col(text_col)), SPACE_RUN)
    rows = texts.select(*keys, words.alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    terms = rows.select(*keys, "words", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    word, before = F.element_at("words", F.col("i")), F.get("words", F.col("i") - 2)
    terms = terms.select(*keys, F.floor((F.col("i") - 1) / BLOCK).alias("block"), F.when(word != "", F.xxhash64(word)).alias("w"), F.when(F.col("i") > 1, F.xxhash64(before, word)).alias("p"))

    def spread(h: str, q: int) -> Column:
        nibble = F.shiftright(F.col(h), LANES * q).bitwiseAND(F.lit(15).cast("long"))
        return (nibble * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES))

    sums = [F.sum(F.coalesce(spread("w", q), F.lit(0).cast("long")) + F.coalesce(spread("p", q) * PAIR_WEIGHT, F.lit(0).cast("long"))).alias(f"v{q}") for q in range(BITS // LANES)]
    votes = F.sum(1 + F.when(F.col("p").isNotNull(), PAIR_WEIGHT).otherwise(0)).alias("votes")
    counted = terms.groupBy(*keys, "block").agg(votes, *sums)
    lanes = [F.shiftright(F.col(f"v{i // LANES}"), 16 * (i % LANES)).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(BITS)]
    whole = counted.groupBy(*keys).agg(F.sum("votes").alias("votes"), *[F.sum(lane).alias(f"b{i}") for i, lane in enumerate(lanes)])
    bits = F.lit(0).cast("long")
    for i in range(BITS):
        bits = bits.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("votes"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return whole.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that two fingerprints' angle stands for, 0 where it is negative."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return F.greatest(F.lit(0.0), F.cos(apart * F.lit(3.141592653589793 / BITS)))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (of its own type), key (MD5 of id and text; null texts are empty) and text of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return docs.select(F.col(id_col).alias("id"), F.md5(F.concat(own, F.lit("|"), text)).alias("key"), text.alias("text"))


def ring(names: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each key beside the one before and the one after, by ascending id; after the last comes the first.

    names has id, key, n_chars. Null ids come first, and keys of one id are ordered by
    key. Keys are sorted in ranges that Spark cuts by the ids and keys there are, so
    that ids may cluster or lie far apart; the ends of each range, which meet the next
    one's, are a row for each of at most MAX_RANGES. Returns key, after, before,
    n_before (characters of the one before), a row for each different key.
    """
    order = [F.col("id").asc_nulls_first(), F.col("key")]
    ranges = min(MAX_RANGES, max(1, names.count() // rows_per_range))
    one = names.groupBy("id", "key").agg(F.max("n_chars").alias("n_chars"))
    ranged = materialise(one.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")  # written, so that a rerun can't cut anew
    ends = ranged.groupBy("range").agg(F.min(F.struct("id", "key"))["key"].alias("first"), F.max(F.struct("id", "key", "n_chars")).alias("last"))
    by_range, every = W.orderBy("range"), W.partitionBy()
    ends = ends.select(
        F.col("range").alias("of"),
        F.coalesce(F.lead("first").over(by_range), F.min(F.struct("range", "first")).over(every)["first"]).alias("first_after"),
        F.coalesce(F.lag("last").over(by_range), F.max(F.struct("range", "last")).over(every)["last"]).alias("last_before"),
    )
    inside = W.partitionBy("range").orderBy(*order)
    beside = ranged.select("range", "key", F.lead("key").over(inside).alias("after"), F.lag(F.struct("key", "n_chars")).over(inside).alias("before"))
    out = beside.join(F.broadcast(ends), F.col("range") == F.col("of"))
    return out.select("key", F.coalesce("after", "first_after").alias("after"), F.coalesce("before.key", "last_before.key").alias("before"), F.coalesce("before.n_chars", "last_before.n_chars").alias("n_before"))


def with_edits(rows: DataFrame, beside: DataFrame) -> DataFrame:
    """key, n_chars, text and edited of each different key: the last quarter of the code points gives way to the next text's first.

    rows as of named(), beside as of ring(). Each text lends only as many characters
    as the one before it takes.
    """
    texts = rows.select("key", "text").dropDuplicates(["key"])
    lent = texts.join(beside, "key").select(F.col("before").alias("key"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_before") / 4).cast("int")).alias("lent"))
    n = F.length("text")
    return texts.join(lent, "key").select("key", n.cast("long").alias("n_chars"), "text", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), "lent").alias("edited"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, its edited text and the next text, and their likeness.

    The edited text has its last floor(n / 4) code points replaced by the first as
    many of the next document by ascending id; after the last comes the first. Null
    ids come first, documents of one id follow a hash of their text, and rows that
    repeat id and text are one document, each of them returned. Ids are of any type
    that can be ordered. Null texts are empty; an empty table stays empty. Returns
    one row per input row: id, n_chars, edited_sha256, own, edited, next (long
    fingerprints), near_edited, near_next.
    """
    rows = named(docs, id_col, text_col)
    names = materialise(rows.select("id", "key", F.length("text").cast("long").alias("n_chars")), "names")
    beside = materialise(ring(names), "ring")
    keys = ["key", "n_chars", "edited_sha256"]
    sides = with_edits(rows, beside).select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s"))
    prints = fingerprints(sides.select(*keys, "s.side", "s.text"), [*keys, "side"])
    prints = prints.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited"))
    prints = materialise(prints, "prints")
    after = prints.select(F.col("key").alias("after"), F.col("own").alias("next"))
    found = prints.join(beside.select("key", "after"), "key").join(after, "after")
    out = names.select("id", "key").join(found, "key")
    return out.select("id", "n_chars", "edited_sha256", "own", "edited", "next", likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def search(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6, own: bool = False) -> DataFrame:
    """All fingerprints within radius bits of each query's.

    prints and queries have a long column fingerprint; equal ones are one class.
    Returns query, fingerprint (another class's, or also the query's own), distance,
    n (rows of the class). A query has at most as many classes as there are numbers
    within the radius, 43,745 for three bits.
    Fingerprints within the radius differ in at most radius blocks, so they agree
    on some choice of blocks - radius of them; a pair is reported by the first
    choice that it agrees on. Nulls are ignored.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long")
    choices = list(combinations(range(blocks), blocks - radius))
    tables = lambda c: F.explode(F.array(*[F.struct(F.lit(t).alias("t"), c.bitwiseAND(signed(sum(masks[i] for i in choice))).alias("key")) for t, choice in enumerate(choices)]))
    classes = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = queries.where("fingerprint is not null").select(F.col("fingerprint").alias("query")).distinct()
    here = classes.select("fingerprint", "n", tables(F.col("fingerprint")).alias("p")).select("fingerprint", "n", F.col("p.t").alias("t"), F.col("p.key").alias("key"))
    there = asked.select("query", tables(F.col("query")).alias("p")).select("query", F.col("p.t").alias("t"), F.col("p.key").alias("key"))
    apart = F.col("fingerprint").bitwiseXOR(F.col("query"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(signed(sum(masks[i] for i in choice))) == 0, F.lit(t)) for t, choice in enumerate(choices)])
    # By merging: rows of `there` are many times its fingerprints, whose size alone would decide on a broadcast.
    pairs = here.join(there.hint("merge"), ["t", "key"]).where((F.bit_count(apart) <= radius) & (first == F.col("t")))
    pairs = pairs if own else pairs.where("fingerprint <> query")
    return pairs.select("query", "fingerprint", F.bit_count(apart).alias("distance"), "n")
