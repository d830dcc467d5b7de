"""Streams that keep state, against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import bursts as B
from quern.operators import lifecycle as L
from quern.operators import measures as M
from quern.streaming import state


def run(spark, files, schema, make, tmp_path, name):
    """Rows that make() gives of a stream of files, one file a batch."""
    state.rocksdb(spark)
    folder = tmp_path / name
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder / f"b{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{folder}/*")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), q


CHANGES = "ts timestamp, path string"


def test_bursts_of_all_paths(spark):
    """Whatever the spans of time, and against a plain pass over all changes in order."""
    rng = random.Random(3)
    at, rows = 1_700_000_000, []
    for _ in range(400):
        at += rng.choice([0, 1, 20, 299, 300, 301, 900, 5000])
        rows.append((at, f"f{rng.randrange(9)}"))
    want, last = {}, None
    for t, p in rows:
        if last is None or t - last > 300:
            start = t
        last = t
        want[start, p] = want.get((start, p), 0) + 1
    df = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "t long, path string").select(F.timestamp_seconds("t").alias("ts"), "path")
    for span in ("1 minute", "10 minutes", "2 hours", "30 days"):
        found = {(r.b, r.path): r.changes for r in B.bursts(df, "300 seconds", span).withColumn("b", F.unix_seconds("burst")).collect()}
        assert found == want
    assert B.bursts(df.limit(0)).count() == 0


def test_debounced_stream_as_batch(spark, tmp_path):
    rng = random.Random(5)
    at, rows = 1_700_000_000, []
    for _ in range(60):
        at += rng.choice([1, 30, 60, 61, 90, 400])
        rows.append((at, f"f{rng.randrange(4)}"))
    stamped = [(spark.range(1).select(F.timestamp_seconds(F.lit(t)).alias("x")).first().x, p) for t, p in rows]
    end = spark.range(1).select(F.timestamp_seconds(F.lit(at + 10_000)).alias("x")).first().x
    # within the watermark, changes come in any order
    order = [stamped[i] for i in sorted(range(60), key=lambda i: i + rng.randrange(4))]
    files = [order[i : i + 10] for i in range(0, 60, 10)] + [[(end, "end")], [(end, "end")]]
    found, _ = run(spark, files, CHANGES, lambda s: state.debounce_all(s, "60 seconds", "1 hour"), tmp_path, "debounced")
    batch = B.bursts(spark.createDataFrame(stamped, CHANGES), "60 seconds")
    assert sorted((r.first_ts, r.path, r.changes) for r in found) == sorted((r.burst, r.path, r.changes) for r in batch.collect())


VERSIONS = "ord long, uri string, hash string, ts timestamp"


def versions(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randrange(5)}", f"h{rng.randrange(3)}", 1_700_000_000 + i * 60) for i in range(n)]
    df = spark.createDataFrame(rows, "ord long, uri string, hash string, t long").select("ord", "uri", "hash", F.timestamp_seconds("t").alias("ts"))
    return df, [tuple(r) for r in df.orderBy("ord").collect()]


def test_shuffled_versions_as_batch_and_state_that_ends(spark, tmp_path):
    df, rows = versions(spark, 90, 6)
    rng = random.Random(7)
    mixed = [rows[i] for i in sorted(range(90), key=lambda i: i + rng.randrange(20))]
    far = spark.range(1).select((F.timestamp_seconds(F.lit(1_700_000_000)) + F.expr("interval 40 days")).alias("x")).first().x
    files = [mixed[i : i + 15] for i in range(0, 90, 15)] + [[(1000 + i, "end", "h", far)] for i in range(2)]
    found, q = run(spark, files, VERSIONS, lambda s: state.changed_in_order(s, "1 hour", "30 days"), tmp_path, "changed")
    want = {(r.ord, r.uri, r.hash) for r in M.changed_only(df).collect()}
    assert {tuple(r) for r in found if r.uri != "end"} == want and len([r for r in found if r.uri != "end"]) == len(want)
    # the five uris' states are gone once they were quiet for long enough
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_superseding_requests_as_batch(spark, tmp_path):
    df, rows = versions(spark, 60, 8)
    mixed = random.Random(9).sample(rows, 60)
    found, _ = run(spark, [mixed[i : i + 12] for i in range(0, 60, 12)], VERSIONS, lambda s: state.superseding(s, "2 days"), tmp_path, "newest")
    last = {}
    for r in found:
        assert r.ord > last.get(r.uri, -1)
        last[r.uri] = r.ord
    assert last == {r.uri: r.ord for r in L.latest_generation(df, "uri", ["ts", "ord"]).collect()}


@pytest.mark.parametrize(("text", "ms"), [("300 milliseconds", 300), ("10 minutes", 600_000), ("1 hour", 3_600_000)])
def test_intervals(text, ms):
    assert state.millis(text) == ms
