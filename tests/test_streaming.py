from lodestone.plans import fixture
from lodestone.streaming import matching


def test_stream_equals_batch(spark, tmp_path):
    records = fixture.records(spark, "/root/testdata/sf0.001").drop("whole")
    index = str(tmp_path / "index")
    matching.posting_index(records, fixture.CAP).write.parquet(index)
    queries = records.where("source = 1")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    matching.match_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "check"), 3).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    want = matching.match(queries, spark.read.parquet(index), 3)
    assert found.select("batch").distinct().count() > 1
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
