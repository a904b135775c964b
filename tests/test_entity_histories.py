from strandbook import registry

DIR = "/root/testdata/sf0.001"


def test_histories_hold_every_entity_in_order(spark):
    ops = [tuple(r) for r in spark.read.parquet(f"{DIR}/events.parquet").selectExpr("user_id", "(unix_micros(cast(ts AS timestamp)) - 1704067200000000) div 2000000", "event_id").collect()]
    got = [(r["entity_key"], r["tx_hash"]) for r in registry.QUERIES["entity_histories"](spark, DIR).collect()]
    assert got == [(entity, tx) for entity, _, tx in sorted(ops)] and len({entity for entity, _ in got}) > 1
