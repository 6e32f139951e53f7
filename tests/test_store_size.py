import os

from tixspark.sources.store import FactStore

ROWS = [("a", "one", "one"), ("b", "two", "2"), ("c", None, "x"), ("d", "y", None), ("e", None, None)]


def test_equal_columns_are_stored_once_and_read_as_they_were(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2)
    frame = spark.createDataFrame(ROWS, "ticket_id string, description string, sanitized_text string")
    assert store.append("t", frame, 0, same=("description", "sanitized_text"))
    assert store.read("t").columns == ["ticket_id", "description", "sanitized_text", "batch_id"]
    got = lambda s: sorted((tuple(r)[:3] for r in s.read("t").collect()))
    assert got(store) == ROWS
    stored = {r.ticket_id: r.description for r in spark.read.parquet(f"{store.root}/t").collect()}
    assert stored == {"a": None, "b": "two", "c": None, "d": "y", "e": None}
    spark.sql(f"drop table {store.name_of('t')}")  # another session takes it from the folder
    again = FactStore(spark, store.root)
    assert got(again) == ROWS and again.append("t", frame, 1) and again.read("t").count() == 10


def test_a_large_bucket_is_shared_between_tasks(spark, tmp_path):
    """What one task sorts is bounded by the advisory size, not by the bucket."""
    rows = spark.range(0, 4000, 1, 8).selectExpr("concat('k', id % 7) as ticket_id", "array_join(transform(sequence(1, 10), i -> sha2(cast(id * 10 + i as string), 256)), '') as body")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        store = FactStore(spark, str(tmp_path / "s"), buckets=2)
        store.append("t", rows, 0)
        files = [f for _, _, names in os.walk(f"{store.root}/t") for f in names if f.endswith(".parquet")]
        assert len(files) > 4
        assert store.read("t").groupBy("ticket_id").count().agg({"count": "sum"}).first()[0] == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
