from veil.streaming import BinModel, NoiseModel, mask_stream, pseudonymize_stream

SF = "/root/testdata/sf0.01"


def test_stream_matches_batch(spark, scratch):
    batch = spark.read.parquet(f"{SF}/customer.parquet")
    model = BinModel.fit(batch, "c_acctbal", bins=10)
    noise = NoiseModel.fit(batch, "c_nationkey", key=["c_custkey"], noise_std=0.1, random_state=5)
    stream = spark.readStream.schema(batch.schema).option("basePath", SF).parquet(f"{SF}/customer*.parquet")

    def steps(df):
        df = noise.transform(model.transform(df))
        return pseudonymize_stream(mask_stream(df, "c_name", "mask_last_k", k=4), ["c_custkey"], secret="s")

    path = scratch("stream")
    q = (steps(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/_ck")
         .trigger(availableNow=True).start(f"{path}/out"))
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(f"{path}/out")
    assert got.count() == batch.count()
    assert got.exceptAll(steps(batch)).count() == 0


def test_bin_model_clamps_out_of_range(spark):
    fit_on = spark.createDataFrame([(1.0,), (10.0,)], "v double")
    m = BinModel.fit(fit_on, "v", bins=3)
    out = m.transform(spark.createDataFrame([(-5.0,), (50.0,), (None,)], "v double")).collect()
    assert out[0]["v"] == m.bins.mids[0] and out[1]["v"] == m.bins.mids[-1] and out[2]["v"] is None


def test_release_on_a_stream(spark, scratch):
    import pytest

    from veil import Metadata, Release

    batch = spark.read.parquet(f"{SF}/customer.parquet")
    stream = spark.readStream.schema(batch.schema).option("basePath", SF).parquet(f"{SF}/customer*.parquet")
    r = Release(stream, Metadata({"c_acctbal": "numeric"}, identifiers=["c_custkey"]))
    masked = r.mask("c_name", "mask_first_k", k=3).random_pseudonyms(secret="s")  # row-local verbs work
    assert masked.working().isStreaming
    for call in (lambda: r.generalize("c_acctbal"), lambda: r.order_preserving_pseudonyms(), lambda: r.statistics()):
        with pytest.raises(TypeError):
            call()
