from kmerloom.streaming.counts import stream_kmers, windowed_yield


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name)


def test_streamed_counts(spark, tmp_path):
    rows = [("ACGTAC", "2024-01-01 00:01:00"), ("GTACGT", "2024-01-01 00:02:00"), ("ACN", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "seq string, ts string").selectExpr("seq", "cast(ts AS timestamp) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string, ts timestamp").parquet(str(tmp_path / "in"))
    got = {r.kmer: r.cnt for r in drain(spark, stream_kmers(stream, 3), "kmer_counts", "complete").collect()}
    assert got == {"ACG": 4, "GTA": 4}
    windows = drain(spark, windowed_yield(stream), "yields", "append").collect()
    assert sum(r.n_reads for r in windows) in (2, 3)
