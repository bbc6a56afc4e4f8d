"""The guard over a stream gives the rows of the batch replay."""

from codeloom.operators.agentlog import guard_replay
from codeloom.streaming.guard import guard_stream

KINDS = ("edit", "test", "diff", "submit", "small_read", "broad", "inspect")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"i{k % 3}", k, KINDS[(k * k + k // 5) % 7], k % 50 == 20) for k in range(240)]
    schema = "instance string, ord long, kind string, located boolean"
    for n, a in enumerate(range(0, 240, 60)):  # a file for each trigger
        spark.createDataFrame(rows[a : a + 60], schema).coalesce(1).write.json(f"{tmp_path}/in/{n}")
    expected = {tuple(r) for r in guard_replay(spark.createDataFrame(rows, schema)).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    query = guard_stream(stream).writeStream.format("memory").queryName("guarded").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("guarded").select("instance", "ord", "step", "notice", "tool_step", "blocked").collect()} == expected
