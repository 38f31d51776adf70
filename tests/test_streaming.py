import os
import tempfile

import pytest
from pyspark.sql import functions as F

from panelrisk.streaming.events_stream import events_daily_stream, run_to_files, with_open_days

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_streaming_daily_matches_batch(spark):
    folder = tempfile.mkdtemp(prefix="panelrisk-stream-")
    closed = run_to_files(events_daily_stream(spark, SF), f"{folder}/out", f"{folder}/checkpoint")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    batch = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    want = {(r["user_id"], r["day"]): r["n_events"] for r in batch.collect()}
    assert 0 < closed.count() < len(want)
    got = with_open_days(spark, closed, SF).collect()
    assert {(r["user_id"], r["day"]): r["n_events"] for r in got} == want and len(got) == len(want)
