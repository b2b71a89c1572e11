"""Lag out of the progress of running streams."""

import time

from freshet.operators import metrics
from freshet.streaming.lag import LagSamples, offsets_behind


def test_offsets_of_partitions():
    assert offsets_behind('{"t": {"0": 10, "1": 7}, "u": {"0": 3}}', '{"t": {"0": 4, "1": 9}}') == 6
    assert offsets_behind("12", "5") == 7
    assert offsets_behind(None, '{"logOffset": 3}') is None
    assert offsets_behind("null", "null") is None


def test_a_stream_behind_its_source_catches_up(spark, tmp_path):
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    lag = LagSamples("behind", rows=40)
    spark.streams.addListener(lag)
    try:
        rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        rows.writeStream.queryName("behind").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # progress comes some time after the batch
            if lag.kept and lag.kept[-1][1] == 0:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(lag)
    got = [r.lag for r in lag.samples(spark).orderBy("seq").collect() if r.rows]
    assert got == [30, 20, 10, 0]
    ramp = metrics.lag_ramp(lag.samples(spark).where("rows > 0")).first()
    assert (ramp["max_lag"], ramp["end_lag"], ramp["ramped"]) == (30, 0, False)
