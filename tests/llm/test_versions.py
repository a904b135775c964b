import pytest

from strandbook.llm import shards
from strandbook.llm.common import Scratch


def test_versions_stay_until_vacuum(spark):
    store = shards.ShardStore(spark, Scratch(spark).root, target=1 << 20, base=1 << 10)
    for part in range(4):
        store.append(spark.range(part * 10, part * 10 + 10, numPartitions=1))
    schema = "id long"
    last = store.compact(schema)
    assert last > 4 and [store.read(schema, v).count() for v in range(1, last + 1)][:4] == [10, 20, 30, 40]
    assert {r["__shard"]["tier"] for r in store.read(schema, shard=True).collect()} == {r["tier"] for r in store.manifest().collect()}
    left = [s.getPath().getName() for s in store._fs.listStatus(store._path(f"{store.root}/commits"))]
    assert not [n for n in left if n.startswith("_")]
    store.vacuum(keep=2)
    assert store.read(schema, last - 1).count() == store.read(schema).count() == 40
    with pytest.raises(Exception):
        store.manifest(1)
