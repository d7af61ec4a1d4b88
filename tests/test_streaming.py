"""The online matcher against the batch one, over several micro-batches."""

import random

from petrelspark.operators import sequence
from petrelspark.streaming.matcher import online_witnesses


def test_online_equals_batch(spark, tmp_path):
    r = random.Random(6)
    events = [(k, r.randrange(3), r.choice("xy"), r.choice(["load", "store"])) for k in range(1, 121)]
    schema = "idx long, tid int, var string, kind string"
    for b in range(3):
        spark.createDataFrame(events[40 * b : 40 * b + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = online_witnesses(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    names = ["rule", "var", "tid_i", "tid_j", "start_idx", "mid_idx", "end_idx"]
    got = {tuple(x) for x in spark.table("found").select(*names).collect()}
    want = {tuple(x) for x in sequence.witnesses(spark.createDataFrame(events, schema)).select(*names).collect()}
    assert got == want and want
