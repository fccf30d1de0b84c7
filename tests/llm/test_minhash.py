import random

import numpy as np
import pyarrow as pa
from odd import odd_rows, words
from duck import assert_same

from fedframe.llm import minhash as M
from fedframe.llm import queries

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """(id, n, component) of each row, by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(bytes(LOWER.get(i, i) for i in range(256))).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids and sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_query(spark, sf):
    assert_same(queries.op6_minhash(spark, sf), queries.oracle_sql()["op6_minhash"], sf)


def test_odd_rows(odd, empty):
    assert got(M.near_duplicates(odd)) == brute([r[:2] for r in odd_rows()])
    assert M.near_duplicates(empty).count() == 0


def test_chains_and_borderline_groups(spark):
    """A large group in which some pairs are just within and many just beyond the threshold."""
    r, rows = random.Random(7), []
    base = words(90, 11).split()
    for i in range(220):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    chain = words(100, 12).split()
    for i in range(12):
        rows.append((2000 + i, " ".join(chain)))
        chain = [*chain[4:], *words(4, 100 + i).split()]
    passage = words(55, 13)
    rows += [(3000 + i, f"{words(r.randrange(20, 80), 200 + i)} {passage}") for i in range(60)]
    rows += [(4000 + i, words(60, 500 + i % 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.near_duplicates(df)) == brute(rows)


def test_blocks_lose_no_link(spark):
    """Stars cut into many blocks find what one block finds."""
    r = random.Random(3)
    sets = [sorted({r.randrange(60) for _ in range(30)}) for _ in range(80)]
    members = spark.createDataFrame([(1, i, i, len(x)) for i, x in enumerate(sets)], "leader long, node long, root long, n int")
    held = spark.createDataFrame(list(enumerate(sets)), "node long, items array<long>")
    links = M.across(members, held, 40, block_items=200).collect()
    root = list(range(80))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wanted = list(range(80))
    for x in links:
        assert len({*sets[x.a]} & {*sets[x.b]}) * 100 >= 40 * len({*sets[x.a]} | {*sets[x.b]})
        root[find(x.a)] = find(x.b)

    def find2(x):
        while wanted[x] != x:
            x = wanted[x]
        return x

    for i in range(80):
        for j in range(i):
            if len({*sets[i]} & {*sets[j]}) * 100 >= 40 * len({*sets[i]} | {*sets[j]}):
                wanted[find2(i)] = find2(j)
    assert all((find(i) == find(j)) == (find2(i) == find2(j)) for i in range(80) for j in range(80))


def test_signatures_estimate_similarity():
    a = np.unique(M._mixed(np.arange(1, 1001, dtype=np.uint64)))
    b = np.unique(M._mixed(np.arange(151, 1151, dtype=np.uint64)))
    same = (M.signature(a, 64) == M.signature(b, 64)).mean()
    assert 0.55 < same < 0.9 and len(M.signature(a[:1])) == M.COORDINATES
    assert M.linked(np.array([1]), [1], pa.array([[1, 2]], pa.list_(pa.int64())), np.array([0]), 75) == []
