from pyspark.sql import functions as F

from eventloom.sources.io import read_events, routed, write_events
from eventloom.plans.api import remap
from eventloom.streaming.stream import counted_windows, remap_stream


def test_program_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 00:0{i}:00", "a" if i % 2 else "b") for i in range(6)], "id long, at string, kind string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, at timestamp, kind string").parquet(f"{tmp_path}/in")
    counts = counted_windows(remap_stream(stream, ".kind = upcase(.kind)"), "at", ["kind"], "10 minutes", "1 minute")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["kind"], r["n"]) for r in spark.sql("SELECT * FROM windows").collect()) == [("A", 3), ("B", 3)]


def test_json_lines_and_routing(spark, tmp_path):
    write_events(spark.createDataFrame([(1, "x"), (2, "3")], "id long, t string"), f"{tmp_path}/e")
    events = read_events(spark, f"{tmp_path}/e", "id long, t string")
    good, failed = routed(remap(events, ".n = to_int!(.t)"))
    assert [r["n"] for r in good.collect()] == [3] and [r["id"] for r in failed.collect()] == [1]
    assert read_events(spark, f"{tmp_path}/e").where("event IS NULL").count() == 0
