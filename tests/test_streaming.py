from pyspark.sql import functions as F

from deltaweave.operators import pairs
from deltaweave.streaming.steps import patch_steps


def test_steps_in_any_order_rebuild_the_stream(spark, tmp_path):
    old = bytes(range(256)) * 40
    new = old[:3000] + b"inserted" * 30 + old[2500:9000] + b"end"
    both = spark.createDataFrame([(1, old, new), (2, b"", b"only literal"), (3, old, old)], "stream_id long, old binary, new binary")
    steps = pairs.find_steps(both, "block", 700).join(both.select("stream_id", "old"), "stream_id")
    last = steps.groupBy("stream_id").agg(F.max("step_no").alias("last_no"))
    steps = steps.join(last, "stream_id").withColumn("last", F.col("step_no") == F.col("last_no")).drop("last_no")
    rows = steps.collect()
    folder = tmp_path / "in"
    for k, part in enumerate((rows[1::2], rows[::2], rows[:1])):  # late first, then the rest, then a repeat
        spark.createDataFrame(part, steps.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    source = spark.readStream.schema(steps.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = patch_steps(source).writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    made = {}
    for r in spark.table("made").orderBy("stream_id", "step_no").collect():
        assert r["out_pos"] == len(made.get(r["stream_id"], b""))
        made[r["stream_id"]] = made.get(r["stream_id"], b"") + bytes(r["bytes"])
    assert made == {1: new, 2: b"only literal", 3: old}
