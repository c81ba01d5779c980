import random

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import keyed

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
HOUR = 3600


def windows(rows, width):
    """(user, event, n-th of its window, start), in order of time; only what the last watermark has passed."""
    upto = max(r[1] for r in rows) - HOUR
    out, state = [], {}
    for e, at, user, kind in sorted((r for r in rows if r[1] <= upto), key=lambda r: (r[1], r[0])):
        start, n = state.get(user, (None, 0))
        if start is None or at >= start + width:
            start, n = at, 0
        state[user] = start, n + 1
        out.append((user, e, n + 1, start, at, kind))
    return out


def make(seed=1, n=120):
    r = random.Random(seed)
    at = 1_700_000_000
    rows = []
    for i in range(n):
        at += r.randrange(0, 1500)
        rows.append((i, at - (r.randrange(0, 3000) if i % 3 == 0 else 0), r.choice([1, 1, 1, 2, 3]), r.choice(["view", "purchase"])))
    return rows


def run(spark, tmp_path, name, rows, build, batches, stop_after=None):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    out, state = f"file://{folder}/out", f"file://{folder}/state"
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(e, u, k, float(t)) for e, t, u, k in part], "event_id long, user_id long, event_type string, s double")
        df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type").coalesce(1).write.parquet(f"file://{folder}/in/{i}")
        if stop_after is None and i + 1 < len(parts):
            continue
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{folder}/in").withColumn("at", F.col("ts"))
        with keyed.rocks(spark):
            q = build(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def limited(stream):
    return keyed.rate_limited(stream, 2 * HOUR, 2)


@pytest.mark.parametrize(("batches", "stop"), [(1, None), (4, None), (4, True)])
def test_rate_windows_follow_event_time(spark, tmp_path, batches, stop):
    """In one batch, in four, and with a restart of the query after each of four."""
    rows = sorted(make(), key=lambda r: r[0])
    got = run(spark, tmp_path, "r", rows, limited, batches, stop)
    want = [(u, e, n <= 2, 0 if n <= 2 else 1000 * (start + 2 * HOUR - at)) for u, e, n, start, at, _ in windows(rows, 2 * HOUR)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_coalesced_requests(spark, tmp_path):
    rows = make(2)
    got = run(spark, tmp_path, "c", rows, lambda s: keyed.coalesced(s, 2 * HOUR, "event_type = 'purchase'"), 3)
    upto = max(r[1] for r in rows) - HOUR
    want = {}
    for u, _, n, start, _, kind in windows(rows, 2 * HOUR):
        if start + 2 * HOUR <= upto:
            old = want.get((u, start), (0, False))
            want[u, start] = n, old[1] or kind == "purchase"
    assert sorted(map(tuple, got.collect())) == sorted((u, 1000 * s, n, full) for (u, s), (n, full) in want.items())


def test_state_of_quiet_keys_expires(spark, tmp_path):
    rows = [(0, 1_700_000_000, 1, "view"), (1, 1_700_000_010, 2, "view"), (2, 1_700_100_000, 3, "view"), (3, 1_700_200_000, 3, "view")]
    run(spark, tmp_path, "e", rows, limited, 4)
    state = f"file://{tmp_path}/e/state"
    for name in ("held", "window"):
        reader = spark.read.format("statestore").option("stateVarName", name)
        left = {r["key"]["user_id"] for r in reader.load(state).select("key").collect()}
        assert left <= {3}
