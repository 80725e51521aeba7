import __spark_entry__ as registered
from tidewell import queries


def test_registered_names():
    names = registered.queries()
    assert set(registered.oracle_sql()) <= set(names)
    assert all(names[k].__wrapped__ is f for k, f in queries.QUERIES.items())


def test_flagship(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp_seconds(1704067200 + id * 1800) AS ts, id % 3 AS user_id, 'a' AS event_type, cast(id % 7 AS double) AS value FROM range(100)").write.parquet(str(tmp_path / "events.parquet"))
    out = queries.hourly_cross(spark, str(tmp_path)).orderBy("bar_index").collect()
    assert len(out) == 50 and out[13].sma is not None and out[12].sma is None and out[7].ema is None and out[8].ema is not None
