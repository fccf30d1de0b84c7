"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Every text becomes the set of its distinct word shingles, as 64-bit hashes.
   Equal sets form a class; only classes take part below, so exact copies cost
   one aggregation and nothing else.
2. A class is posted under each of its signature's (coordinate, value) pairs. Two
   classes at similarity s agree on Binomial(coordinates, s) of them; a pair is a
   candidate from `matches` agreements on. For 48 and 21, a pair at exactly 0.75
   is missed with a chance of about one in a million, less above it.
3. Prefix and skip: posting lists are ordered by length, and each class leaves out
   its matches - 1 longest lists. A pair with enough agreements still meets in a
   list that both kept, and lists that a common passage makes long are left out.
   A class with fewer than `matches` shared pairs has no partner and vanishes.
4. Each list is led by its most central member, the one with the most shared
   pairs. Members are first compared with their leaders only; confirmed links merge
   classes into components. A leader's star, which holds every pair of its lists,
   is done if it is one component. Members of the others are compared across
   components in blocks of bounded size, and a block returns no more links than it
   needs to join what it found linked. So a large group of copies costs a star or
   a few blocks, and its pairs are never enumerated as rows.
5. Agreements are counted on whole signatures, and links confirmed on full sets.

No bucket, partner or candidate is capped. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches, tidy
from .graph import components

SHINGLE = 5
PERCENT = 75
COORDINATES = 48
MATCHES = 21
#: Low bits of a signature value that hold its coordinate.
COORDINATE_BITS = 6
#: Elements of the coordinates-by-shingles block that is hashed at once.
BLOCK = 1 << 18
#: Set items in a block of a star whose members are compared with each other.
BLOCK_ITEMS = 1 << 19

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RANDOM = np.random.default_rng(20240611)
_FACTORS = _RANDOM.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles.

    Words are runs of other than ASCII white space, A-Z in lower case. Fewer words
    than width are one shingle; no word or no text gives the empty set.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in words]), ">u8").astype(np.uint64)
    n = max(1, len(words) - width + 1)
    found = np.full(n, min(len(words), width), np.uint64)
    for i in range(min(len(words), width)):
        found = found * _WORD + hashes[i : i + n]
    return np.unique(_mixed(found))


def signature(found: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The smallest value of each coordinate's hash over a set, with the coordinate in its low bits."""
    factors = _FACTORS[:coordinates, None]
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, BLOCK // coordinates)
    for i in range(0, len(found), step):
        least = np.minimum(least, (factors * found[None, i : i + step]).min(axis=1))
    low = np.uint64((1 << COORDINATE_BITS) - 1)
    return ((least & ~low) | np.arange(coordinates, dtype=np.uint64)).view(np.int64)


def _class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    heads = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(heads), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64)))


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int, digests: bool = False) -> DataFrame:
    """id, n (set size), node (class of equal sets, null for the empty set), sig (empty for it), and digest (SHA-256 of the text, null for none) if asked for."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), width) for x in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([_class_of(x) if len(x) else None for x in sets], pa.int64()),
                _lists([signature(x, coordinates) if len(x) else np.zeros(0, np.int64) for x in sets]),
            ]
            if digests:
                columns.append(pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() if x.is_valid else None for x in batch.column(1)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "node", "sig", "digest"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(tidy(run), f"id {kind.simpleString()}, n long, node long, sig array<long>" + (", digest string" if digests else ""))


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """node, items (its whole set) for the classes in wanted (id of a member, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), width) for x in batch.column(1)]
            nodes = batch.column(0).to_pylist()
            own = [i for i, x in enumerate(sets) if _class_of(x) == nodes[i]]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in own], pa.int64()), _lists([sets[i].view(np.int64) for i in own])], names=["node", "items"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(wanted.hint("shuffle_hash"), rows["id"].eqNullSafe(wanted["id"])).select("node", "text")
    return small_batches(rows).mapInArrow(tidy(run), "node long, items array<long>")


def linked(rows: np.ndarray, roots: list[int], items: pa.ListArray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what has different roots, between rows of different sides (or any, if there is one).

    Every pair of different roots is counted, by walking each row's items through
    an index of all; of links within what is joined already only one is returned.
    """
    values, heads = items.flatten().to_numpy(), items.offsets.to_numpy() - items.offsets[0].as_py()
    sizes = np.diff(heads)
    owners = np.repeat(np.arange(len(rows)), sizes)
    _, number = np.unique(values, return_inverse=True)
    order = np.argsort(number, kind="stable")
    lists, starts = owners[order], np.concatenate([[0], np.cumsum(np.bincount(number))])
    parent = {r: r for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, one_side = [], len(np.unique(side)) == 1
    for i in range(len(rows)):
        own = number[heads[i] : heads[i + 1]]
        low, n = starts[own], starts[own + 1] - starts[own]
        n_all = int(n.sum())
        at = np.arange(n_all) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        shared = np.bincount(lists[at], minlength=len(rows))
        hit = (100 + percent) * shared >= percent * (sizes + sizes[i])
        hit[: i + 1] = False
        if not one_side:
            hit &= side != side[i]
        for j in np.nonzero(hit)[0]:
            a, b = find(roots[i]), find(roots[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(rows[i]), int(rows[j])))
    return out


def across(members: DataFrame, sets: DataFrame, percent: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Links (a, b) between members (leader, node, root, n: set size) of one star with different roots.

    A star is cut into blocks of about block_items items, and each pair of blocks
    is compared in a task of its own, which holds those two alone. Stars of one
    root are left out. Leaders' totals are summed before they are shuffled, and a
    large star is only a skewed key of one join.
    """
    totals = members.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.sum("n") / block_items).cast("int").alias("blocks"))
    open_stars = totals.where("low < high").select("leader", "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(open_stars, "leader").select("leader", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("leader", "node", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        items = table.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        found = linked(table.column("node").to_numpy(), table.column("root").to_pylist(), items, table.column("own").to_numpy(), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return placed.join(sets, "node").groupBy("leader", "x", "y").applyInArrow(compare, "a long, b long")


def _near(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, coordinates: int, matches: int, digests: bool = False) -> DataFrame:
    """Each row's id, n, digest (if asked for), root (names its component, null for the empty set) and component (see near_duplicates)."""
    rows = materialise(signed(docs, id_col, text_col, width, coordinates, digests), "signed")
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    classes = materialise(classes, "classes")

    posted = classes.select("node", F.explode("sig").alias("key"))
    lengths = posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    posted = posted.join(lengths, "key")
    own = posted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("lists"))  # at most one for each coordinate
    own = own.where(F.size("lists") >= matches)
    posted = own.select("node", F.size("lists").alias("shared"), F.explode(F.slice("lists", F.lit(1), F.size("lists") - (matches - 1))).alias("list")).select("node", "shared", F.col("list.key").alias("key"))
    posted = materialise(posted, "posted")

    nodes = posted.select("node").distinct()
    sets = materialise(full_sets(docs, classes.join(nodes, "node").select("id", "node"), id_col, text_col, width), "sets")

    leaders = posted.groupBy("key").agg(F.max(F.struct("shared", "node"))["node"].alias("leader"), F.count("*").alias("members")).where("members > 1")
    stars = posted.join(leaders, "key").where("node <> leader").select("leader", "node").distinct()
    stars = materialise(stars, "stars")

    left = classes.select(F.col("node").alias("leader"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    pairs = stars.join(left, "leader").join(classes.select("node", F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "node")
    pairs = pairs.where(_near(F.col("n_a"), F.col("n_b"), percent) & (F.size(F.array_intersect("sig_a", "sig_b")) >= matches)).select("leader", "node")
    both = pairs.join(sets.select(F.col("node").alias("leader"), F.col("items").alias("items_a")), "leader").join(sets, "node")
    shared = F.size(F.array_intersect("items_a", "items"))
    both = both.select("leader", "node", (F.size("items_a") + F.size("items")).alias("total"), shared.alias("shared"))
    links = both.where((100 + percent) * F.col("shared") >= percent * F.col("total")).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = materialise(links, "confirmed")

    roots = components(links)
    members = stars.union(stars.select("leader", "leader").distinct()).join(sets.select("node", F.size("items").alias("n")), "node")
    members = materialise(members.join(roots, "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root"), "n"), "members")
    more = across(members, sets, percent)
    roots = components(links.union(more))
    discard(posted, sets, stars, links, members)

    labels = classes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    labels = labels.join(least, "root").select("node", "root", "component")
    out = rows.select("id", "n", "node", *(["digest"] if digests else [])).join(labels, "node", "left")
    return out.withColumn("component", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))).drop("node")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    percent: int = PERCENT,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of percent or more.

    Returns one row per input row: id_col, n_shingles, component_id (the smallest
    id reachable, the row's own included), kept (id equals component_id). Null,
    empty and blank texts have no shingles and are linked with nothing: their
    component is their own id. Rows that repeat an id are rows of their own; those
    that are the component's smallest id are all kept. A null id is the component
    only where no member has an id. An empty table gives an empty result.
    """
    out = labelled(docs, id_col, text_col, width, percent, coordinates, matches)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the text, null for none) and copies (rows that have both) of the one document that stays of each component.

    It is the one of the smallest id, of several texts with that id the one whose
    digest is least. Texts without shingles stay once for each id and text.
    """
    rows = labelled(docs, id_col, text_col, SHINGLE, PERCENT, COORDINATES, MATCHES, digests=True).where(F.col("id").eqNullSafe(F.col("component")))
    rows = rows.groupBy("root", "id", "digest").agg(F.count("*").alias("copies"))
    alone = [F.when(F.col("root").isNull(), F.col(c)).alias(f"own_{c}") for c in ("id", "digest")]
    return rows.groupBy("root", *alone).agg(F.min(F.struct("digest", "id", "copies")).alias("one")).select("one.id", "one.digest", "one.copies")


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sh),
x AS (SELECT doc_id, unnest(s) AS g FROM sh),
common AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
y AS MATERIALIZED (SELECT x.doc_id, x.g FROM x JOIN common USING (g)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM y a JOIN y b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT p.a, p.b FROM pairs p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.shared >= 75 * (na.n + nb.n - p.shared)),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""
