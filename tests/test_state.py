"""The debounce over a stream against the same over a table."""

from pyspark.sql import functions as F

from driftlens.plans import bindings, more
from driftlens.plans.registry import QUERIES
from driftlens.streaming import state

SF = "/root/testdata/sf0.001"


def test_debounce_stream_lies_in_files(spark):
    got = QUERIES["debounce_stream"](spark, SF)
    assert got.inputFiles()
    events = more.drifting(bindings.load(spark, SF, "events"))
    last = events.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0]
    want = {tuple(r) for r in state.debounced(events, "2 hours").where(F.col("stop") <= F.lit(last)).collect()}
    assert want and {tuple(r) for r in got.select("key", "start", "stop", "changes").collect()} == want
