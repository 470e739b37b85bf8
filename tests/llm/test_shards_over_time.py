"""Shards over several arrivals."""

import collections

from tessera.llm import sharding

SCHEMA = "doc_id long, text string, source string"


def test_all_rows_stay_over_versions(spark, tmp_path):
    root, want, merged, kept = f"file://{tmp_path}/s", collections.Counter(), 0, 0
    before = set()
    for step in range(7):
        rows = [(step * 100 + i, "x" * (20 + i), f"s{i % 2}") for i in range(12)] + [(None, f"n{step}", None), (5, None, "s0"), (5, None, "s0")]
        want.update(rows)
        df = spark.createDataFrame(rows, SCHEMA)
        arrivals = [sharding.append(df, root)] if step else [sharding.append(df.where("doc_id < 6 OR doc_id IS NULL"), root), sharding.append(df.where("doc_id >= 6"), root)]
        assert sharding.compact(spark, root, arrivals, target=4000)["version"] == step + 1
        assert collections.Counter(tuple(r.row) for r in sharding.view(spark, root).collect()) == want
        m = sharding.manifest(spark, root).collect()
        assert sum(r.docs for r in m) == sum(want.values()) and len({r.shard for r in m}) == len(m)
        per = collections.Counter(r.shard for r in sharding.view(spark, root).collect())
        assert per == {r.shard: r.docs for r in m}
        now = {(r.base, r.file) for r in m}
        kept, merged, before = kept + len(before & now), merged + len(before - now), now
    assert kept and merged  # some by reference, some merged
    small = collections.Counter((len(f"{r.bytes:b}") - 1) // 2 for r in m if r.bytes * 2 < 4000 and r.region == 0)
    assert max(small.values()) <= sharding.FULL


def test_sharded_keeps_what_was_committed(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], SCHEMA)
    two = spark.createDataFrame([(3, "d", "t")], SCHEMA)
    assert sharding.sharded(one.limit(0), root).count() == 0
    assert sorted(r.doc_id for r in sharding.sharded(one, root).collect()) == [1, 2]
    assert sorted(r.doc_id for r in sharding.sharded(two, root).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in sharding.sharded(one.limit(0), root).collect()) == [1, 2, 3]
