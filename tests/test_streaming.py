from pyspark.sql import functions as F

from tesserae.streaming.strokes import strokes


def test_stream_equals_table(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", s, 2 * s) for s in (0, 4, 8, 30, 35)] + [("b", "2024-01-01 00:00:05", 1, 1)]
    table = spark.createDataFrame(rows, "actor string, at string, x int, y int").withColumn("at", F.to_timestamp("at"))
    table.write.parquet(f"{tmp_path}/in")
    expected = sorted(map(tuple, strokes(table).collect()))
    assert [r[3] for r in expected] == [3, 2, 1]
    stream = strokes(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("strokes").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("strokes").collect())) == expected
