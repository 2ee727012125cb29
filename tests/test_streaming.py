"""The per-row URL stage runs on a stream (available-now trigger)."""

import tempfile

from lexaudit.streaming.urls import normalized_url_stream


def test_url_stream(spark):
    src = tempfile.mkdtemp(prefix="lexaudit-stream-src-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="lexaudit-stream-ck-", dir="/tmp")
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").write.mode("append").parquet(src)
    s = normalized_url_stream(spark, src)
    q = (s.writeStream.format("memory").queryName("urls_out").option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    out = spark.sql("SELECT * FROM urls_out")
    assert out.count() == 50
    assert out.filter("skip_reason IS NULL").count() > 0
