import hashlib
import math
import re

import xxhash
from odd import odd_rows, words

from fedframe.llm import queries, simhash


def brute(text):
    """The fingerprint by its definition: words and pairs vote on each bit."""
    votes, found, before = [0] * 64, re.findall(r"[^\x20\x09-\x0D]+", text), None
    for word in found:
        own = xxhash.xxh64_intdigest(word.encode(), 42)
        terms = [(own, 1)] if before is None else [(own, 1), (xxhash.xxh64_intdigest(word.encode(), before), simhash.PAIR_WEIGHT)]
        for h, weight in terms:
            for i in range(64):
                votes[i] += weight if h >> i & 1 else -weight
        before = own
    return sum(1 << i for i, x in enumerate(votes) if x > 0)


def after(rows):
    """Rows to what follows each: by id, nulls first, then by the key; repeated rows are one."""
    key = lambda r: hashlib.md5(f"{'n' if r[0] is None else f'i{r[0]}'}|{r[1]}".encode()).hexdigest()
    ordered = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
    return {r: ordered[(i + 1) % len(ordered)] for i, r in enumerate(ordered)}


def wanted(rows):
    out, nexts, prints = [], after(rows), {}
    of = lambda t: prints.setdefault(t, brute(t))
    for r in rows:
        cut, follows = len(r[1]) // 4, nexts[r][1]
        edited = r[1][: len(r[1]) - cut] + follows[:cut]
        near = [max(0.0, math.cos(math.pi * (of(r[1]) ^ of(x)).bit_count() / 64)) for x in (edited, follows)]
        out.append((r[0], len(r[1]), hashlib.sha256(edited.encode()).hexdigest(), of(r[1]), of(edited), *(round(x, 9) for x in near)))
    return sorted(out, key=repr)


def test_query(spark, sf, texts):
    got = queries.op7_simhash(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, int(r.fingerprint, 16), int(r.edited_fingerprint, 16), round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == wanted(texts)
    long = [r for r in got if r.n_chars > 800]
    assert sum(r.near_edited > r.near_next for r in long) > 0.98 * len(long)
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        own = int(r.fingerprint, 16)
        near = [x for x in prints if (x ^ own).bit_count() <= 3]
        classes = ",".join(f"{x:016x}" for x in sorted(set(near) - {own}))
        assert (r.n_near, r.near_classes) == ((len(near) - 1, classes) if r.doc_id % 20 == 0 else (None, None))


def found(df):
    unsigned = lambda x: x & (1 << 64) - 1
    return sorted(((r.id, r.n_chars, r.edited_sha256, unsigned(r.own), unsigned(r.edited), round(r.near_edited, 9), round(r.near_next, 9)) for r in simhash.compare_edits(df).collect()), key=repr)


def test_odd_rows(odd, empty):
    assert found(odd) == wanted([(r[0], r[1] or "") for r in odd_rows()])
    assert simhash.compare_edits(empty).count() == 0


def test_ids_may_cluster_lie_far_apart_or_be_text(spark, monkeypatch):
    monkeypatch.setattr(simhash.ring, "__defaults__", (3,))  # keys in a range
    ids = [-(2**62), 0, *range(5, 30), 2**62 + 5, 2**63 - 1, None, None]
    rows = [(i, words(30 + k % 7, 100 + k)) for k, i in enumerate(ids)] + [(7, words(12, 7))] * 4 + [(None, "")] * 3
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)
    named = [(f"{k:03d}" if k % 5 else None, words(20 + k, k)) for k in range(25)]
    spelled = sorted(named, key=lambda r: (r[0] is not None, r[0] or ""))
    got = {r.id: r.edited_sha256 for r in simhash.compare_edits(spark.createDataFrame(named, "doc_id string, text string")).collect() if r.id}
    for (i, t), (_, t2) in zip(spelled, spelled[1:], strict=False):
        cut = len(t) // 4
        assert i is None or got[i] == hashlib.sha256((t[: len(t) - cut] + t2[:cut]).encode()).hexdigest()


def test_one_document_is_its_own_next(spark):
    (r,) = simhash.compare_edits(spark.createDataFrame([(5, "abcdefgh ijkl")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefgh iabc").hexdigest() and r.near_next == 1.0


def test_votes_of_blocks_add_up(spark):
    text = words(25_000, 5)
    (whole,) = simhash.fingerprints(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).collect()
    old, simhash.BLOCK = simhash.BLOCK, 777
    try:
        (parts,) = simhash.fingerprints(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).collect()
    finally:
        simhash.BLOCK = old
    assert whole.fingerprint == parts.fingerprint


def test_search_finds_every_radius(spark):
    base = 0x123456789ABCDEF0
    near = [base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 64, 9) for b in range(1, 64, 11) for c in range(2, 64, 13)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in [base, base, *near, base ^ 0xFF, base ^ (0xF << 60)]], "fingerprint long")
    got = {(r.fingerprint, r.distance, r.n) for r in simhash.search(df, df.limit(1)).collect()}
    assert got == {(signed(x), (x ^ base).bit_count(), near.count(x)) for x in near if x != base}
