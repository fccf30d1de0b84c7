import pytest
from duck import assert_same

from fedframe.llm import queries
from fedframe.llm.sharding import CommitConflict, ShardStore


def test_query(spark, sf):
    assert_same(queries.op5_sharding(spark, sf), queries.oracle_sql()["op5_sharding"], sf)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_compact_read(spark, odd, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/s", target_bytes=1 << 20, fanout=3)
    for i in range(7):
        assert store.append(odd.coalesce(1)) == i + 1
    before = rows(store.read())
    assert store.manifest().shards == 7 and len(before) == 7 * odd.count()
    confs = [spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.minPartitionNum", None)]
    version = store.compact()
    assert confs == [spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.minPartitionNum", None)]
    shards = store.shards().collect()
    assert len(shards) < 7 and sum(x.rows for x in shards) == len(before) and all(x.bytes <= store.target for x in shards)
    assert rows(store.read()) == before
    assert rows(store.read(3)) == rows(odd.union(odd).union(odd))  # older versions stay readable
    assert store.compact() == version  # nothing left to merge
    assert store.vacuum() >= 7 and store.versions() == [version]
    assert rows(store.read()) == before and {r.s for r in store.read(shard_col="s").select("s").collect()} == {x.shard for x in shards}


def listed(store, sizes):
    """A version whose shards have these sizes; there are no files."""
    made = store.spark.createDataFrame([(f"data/x/{i}", n, 1) for i, n in enumerate(sizes)], "shard string, bytes long, rows long")
    store._commit(store.manifest(), made.schema.json(), made)
    return sorted(r.bytes for r in store.due().collect())


def test_tiers_merge_like_with_like(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/s", target_bytes=1 << 30, fanout=2)
    assert listed(store, [100_000, 110_000, 40_000_000]) == [100_000, 110_000]
    assert listed(store, [100_000, 40_000_000]) == []
    assert listed(store, [1, 2, 65_536, 131_071, 131_073, 200_000]) == [1, 2, 65_536, 131_071, 131_073, 200_000]
    border = 2 * 65_536
    assert listed(store, [border - 10, border + 10, 40_000_000]) == [border - 10, border + 10]
    assert listed(store, [80_000, 230_000]) == []  # not similar
    store.target = 150_000
    assert listed(store, [100_000, 110_000]) == []  # both are above half the target


def test_many_shards_are_merged_to_the_target(spark, docs, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/s", target_bytes=60_000, fanout=4)
    store.append(docs.repartition(40))
    before, sizes = rows(store.read()), store.shards().collect()
    store.compact()
    after = store.shards().collect()
    assert len(after) <= 2 * (1 + sum(x.bytes for x in sizes) // store.target) and max(x.bytes for x in after) <= store.target
    assert rows(store.read()) == before


def test_vacuum_leaves_what_is_being_written(spark, odd, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/s")
    store.append(odd)
    pending = store._write(odd)
    assert store.vacuum() == 0 and pending.count() > 0
    store._commit(store.manifest(), store.manifest().schema, store.shards().drop("tier").union(pending))
    assert store.read().count() == 2 * odd.count()
    store._write(odd)
    assert store.vacuum(grace_seconds=0) > 0 and store.read().count() == 2 * odd.count()


def test_commits_are_atomic(spark, odd, empty, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/s")
    store.append(odd)
    old = store.manifest()
    store.append(empty)
    with pytest.raises(CommitConflict):
        store._commit(old, old.schema, store.shards().drop("tier"))
    assert store.read().count() == odd.count()
    with pytest.raises(ValueError):
        store.append(odd.select("doc_id"))


def test_empty_tables(spark, empty, docs, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read()
    store.append(empty)
    assert store.compact() == 1 and store.read().count() == 0 and store.read().columns == empty.columns
    docs.limit(0).write.parquet(f"{tmp_path}/sf/documents.parquet")
    out = queries.op5_sharding(spark, f"{tmp_path}/sf")
    assert out.count() == 0 and out.columns == ["doc_id", "text_sha256", "n_copies", "shard_ok", "compacted"]
