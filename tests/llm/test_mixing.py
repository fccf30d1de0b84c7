import re

from odd import odd_rows
from duck import assert_same

from fedframe.llm import mixing, queries


def targets(sizes, weights=(5, 2, 1)):
    """By resharing the excess until none is above, in fractions of floats."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    left = float(total)
    while free:
        parts = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / parts >= 3 * sizes[s]}
        if not over:
            for s in free:
                out[s] = left * weight[s] / parts
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(rows, wanted_rows):
    sizes = {}
    for source, n in wanted_rows:
        sizes[source] = sizes.get(source, 0) + n
    want, taken = targets(sizes), {}
    assert len(rows) == len(wanted_rows)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6


def with_source(df, **kw):
    out = mixing.mix(df, **kw)
    return out


def test_query(spark, sf):
    assert_same(queries.op8_mixing(spark, sf), queries.oracle_sql()["op8_mixing"], sf)


def test_odd_rows(odd, empty):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(odd.drop("size", "taken").withColumnRenamed("prefix", "target")).collect()
    per_source = {}
    for r in odd_rows():
        per_source.setdefault(r[3], 0)
        per_source[r[3]] += count(r[1])
    want = targets(per_source)
    assert sorted(r["size"] for r in got) == sorted(count(r[1]) for r in odd_rows())
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}
    assert abs(sum(r.taken for r in got) - sum(want.values())) <= len(want)
    assert mixing.mix(empty).count() == 0


def test_buckets_do_not_matter(docs):
    a = sorted(map(tuple, mixing.mix(docs).collect()))
    b = sorted(map(tuple, mixing.mix(docs.repartition(5), rows_per_bucket=7).collect()))
    assert a == b


def test_groups_of_buckets_do_not_matter(docs, monkeypatch):
    a = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "GROUP", 3)
    assert a == sorted(map(tuple, mixing.mix(docs, rows_per_bucket=7).collect()))


def test_bounds_hold(spark):
    rows = [(i, "w " * (i % 5 + 1), s) for i, s in enumerate(["a"] * 3 + ["b"] * 500 + ["c"] * 40 + [None] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    check(got, [(r[2], r[0] % 5 + 1) for r in rows])
