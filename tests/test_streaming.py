from sievelake.streaming.counts import first_deliveries, query_counts
from tests.conftest import DATA


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/train.parquet").select("log_id", "event_ts", "search_query", "item_id")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = query_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, query_counts(batch).collect()))
    d = first_deliveries(stream, keys=("event_ts", "search_query", "item_id"), late="3650 days").writeStream.format("memory").queryName("firsts").start()
    d.processAllAvailable()
    d.stop()
    assert spark.table("firsts").count() == first_deliveries(batch, keys=("event_ts", "search_query", "item_id")).count()
