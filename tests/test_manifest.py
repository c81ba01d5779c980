import pytest
from pyspark.sql import functions as F

from lodestone.operators.manifest import Conflict, KeyedTable, Manifest, StaleWriter, upsert_stream

SCHEMA = "owner string, h string, v long, at long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def state(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["owner", "h"], buckets=4)


def test_of_two_writers_one_wins(spark, tmp_path):
    a, b = (Manifest(spark, f"file://{tmp_path}/m") for _ in range(2))
    assert a.read() == (-1, {})
    assert a.publish(-1, {"x": 1}) == 0
    with pytest.raises(Conflict):
        b.publish(-1, {"x": 2})
    assert b.read() == (0, {"x": 1})
    told = []

    def add(content):
        if not told:  # another writer comes between reading and publishing
            told.append(a.publish(0, {"x": 5}))
        return {"x": content["x"] + 1}

    assert b.change(add) == 2 and a.read() == (2, {"x": 6})
    assert not [p for p in a.folders("versions") if "draft" in p]


def test_upsert_is_keyed_by_owner_and_hash(spark, table):
    table.upsert(rows(spark, ("a", "h1", 1, 1), ("b", "h1", 2, 1), ("a", "h1", 3, 2)), ["at"])
    assert state(table.read()) == [("a", "h1", 3, 2), ("b", "h1", 2, 1)]
    before = table.manifest.read()[0]
    table.upsert(rows(spark, ("a", "h2", 9, 1), ("b", "h1", 0, 9)), ["at"], gone=F.col("v") == 0)
    assert state(table.read()) == [("a", "h1", 3, 2), ("a", "h2", 9, 1)]
    assert state(table.read(before)) == [("a", "h1", 3, 2), ("b", "h1", 2, 1)]  # a snapshot stays
    table.upsert(rows(spark, ("a", "h1", 7, 1)), ["at"], newer=True)
    assert ("a", "h1", 3, 2) in state(table.read())  # a late row
    table.upsert(rows(spark, ("b", "h1", 4, 5)), ["at"], newer=True)
    assert not [r for r in state(table.read()) if r[0] == "b"]  # late, too: deleted at 9
    table.upsert(rows(spark, ("b", "h1", 4, 10), ("b", "h1", 0, 9)), ["at"], gone=F.col("v") == 0, newer=True)
    assert ("b", "h1", 4, 10) in state(table.read())
    table.upsert(rows(spark, ("b", "h1", 0, 11)), ["at"], gone=F.col("v") == 0, newer=True)
    table.upsert(rows(spark), ["at"])
    assert table.vacuum() > 0 and len(state(table.read())) == 2


def test_a_crash_between_write_and_publish_changes_nothing(spark, table):
    table.upsert(rows(spark, ("a", "x", 1, 1)), ["at"], stream="s", batch=0, offset={"cursor": "c0"})

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.upsert(rows(spark, ("a", "x", 2, 2), ("a", "y", 2, 2)), ["at"], stream="s", batch=1, offset={"cursor": "c1"}, before_publish=die)
    assert state(table.read()) == [("a", "x", 1, 1)] and table.offset("s") == {"cursor": "c0"}
    for _ in range(2):  # the batch again, and once more
        table.upsert(rows(spark, ("a", "x", 2, 2), ("a", "y", 2, 2)), ["at"], stream="s", batch=1, offset={"cursor": "c1"})
        assert state(table.read()) == [("a", "x", 2, 2), ("a", "y", 2, 2)] and table.offset("s") == {"cursor": "c1"}
    table.upsert(rows(spark, ("a", "x", 0, 0)), ["at"], stream="s", batch=0)
    assert ("a", "x", 2, 2) in state(table.read())


def test_stale_workers_are_fenced(spark, table):
    table.upsert(rows(spark, ("a", "x", 1, 1)), ["at"], token=2)
    with pytest.raises(StaleWriter):
        table.upsert(rows(spark, ("a", "x", 5, 5)), ["at"], token=1)
    assert state(table.read()) == [("a", "x", 1, 1)]


def test_a_stream_is_applied_once(spark, table, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        rows(spark, ("a", f"k{i}", i, i), ("a", "same", i, i)).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        upsert_stream(stream, table, ["at"], "files", f"file://{tmp_path}/{checkpoint}", newer=True).awaitTermination()

    run("c1")
    want = [("a", "k0", 0, 0), ("a", "k1", 1, 1), ("a", "k2", 2, 2), ("a", "same", 2, 2)]
    assert state(table.read()) == want
    versions = table.manifest.versions()
    run("c2")  # a lost checkpoint replays all batches
    assert state(table.read()) == want and table.manifest.versions() == versions
