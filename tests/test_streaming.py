from pyspark.sql import functions as F

from plumbline.streaming import revalidate as rv


def test_only_what_is_new_or_changed_is_checked(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "path string, length long, modified long, bad boolean"
    first = [("a", 1, 1, False), ("b", 1, 1, True)]
    second = [("a", 1, 1, False), ("b", 1, 1, True), ("c", 1, 1, True), ("a", 2, 1, True)]
    got = []
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        rv.revalidate(stream, str(tmp_path / "trusted"), str(tmp_path / "found"), lambda df: df.where("bad").select("path", "length", "modified"), str(tmp_path / "cp")).awaitTermination()
        got.append(sorted((r["batch"], r["path"], r["length"]) for r in spark.read.parquet(str(tmp_path / "found")).collect()))
    assert got[0] == [(0, "b", 1)]
    assert got[1] == [(0, "b", 1), (1, "a", 2), (1, "b", 1), (1, "c", 1)]
    assert sorted((r["batch"], r["path"]) for r in spark.read.parquet(str(tmp_path / "trusted")).collect()) == [(0, "a")]


def test_windows_of_findings(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    found = rv.late_findings(rv.first_seen(stream, "ts", ["event_id"]), "ts", F.col("value") > 50, watermark=None)
    q = found.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    n = spark.sql("select sum(n), sum(n_wrong) from late").first()
    assert 0 < n[0] <= 1000 and 0 < n[1] <= n[0]
