"""The newest version of each path of a stream: late, repeated and out-of-order versions, over restarts."""

import json
import time

import pytest

from siftwood.streaming.newest import PROVIDER, ROCKS, SCHEMA, newest_versions


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set(PROVIDER, ROCKS)
    (tmp_path / "log").mkdir()
    n = [0]

    def run(*rows, grace=0.0):
        """Add a file with these rows, run the stream over what is new from its checkpoint, and give what has come out of it."""
        n[0] += 1
        (tmp_path / "log" / f"{n[0]}.json").write_text("".join(json.dumps(dict(zip(("path", "mtime", "size", "text", "deleted"), r, strict=False))) + "\n" for r in rows))
        out = []
        read = spark.readStream.schema(SCHEMA).json(str(tmp_path / "log"))
        query = newest_versions(read, grace).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r.path, r.mtime, r.text, r.deleted) for r in out)

    yield run
    spark.conf.unset(PROVIDER)


def test_late_repeated_and_unordered_versions(stream):
    first = stream(("a", 2.0, 1, "a2", False), ("a", 1.0, 1, "a1", False), ("a", 3.0, 1, "a3", None), ("b", 1.0, 1, "b1", False), (None, 1.0, 1, "x", False), ("c", None, 1, "x", False), grace=3600.0)
    assert first == [("a", 3.0, "a3", False), ("b", 1.0, "b1", False)]
    # a late one, a repeat, and a newer one; each run starts anew from the checkpoint
    assert stream(("a", 2.5, 1, "late", False), ("a", 3.0, 1, "a3", False), ("b", 2.0, 1, "b2", False), ("b", 2.0, 1, "b2", False), grace=3600.0) == [("b", 2.0, "b2", False)]
    # a late deletion does nothing, a deletion that is followed by a newer version is never seen
    assert stream(("a", 1.5, 0, None, True), ("b", 3.0, 0, None, True), grace=3600.0) == []
    assert stream(("b", 4.0, 1, "b4", False), ("b", 2.5, 1, "late", False), grace=3600.0) == [("b", 4.0, "b4", False)]


def test_a_deletion_comes_out_after_its_grace(stream):
    assert stream(("a", 1.0, 1, "a1", False), ("b", 1.0, 1, "b1", False), grace=0.2) == [("a", 1.0, "a1", False), ("b", 1.0, "b1", False)]
    first = stream(("a", 2.0, 0, None, True), grace=0.2)
    time.sleep(0.5)
    assert first + stream(("b", 2.0, 1, "b2", False), grace=0.2) == [("a", 2.0, None, True), ("b", 2.0, "b2", False)]
    # what is older than the deletion stays out after it
    assert stream(("a", 1.5, 1, "late", False), grace=0.2) == []
    assert stream(("a", 3.0, 1, "again", False), grace=0.2) == [("a", 3.0, "again", False)]


def test_needs_its_state_store(spark, tmp_path):
    with pytest.raises(ValueError, match="providerClass"):
        newest_versions(spark.readStream.schema(SCHEMA).json(str(tmp_path)))


def test_an_index_follows_with_a_grace(spark, tmp_path):
    from siftwood.plans.engine import Engine
    from siftwood.streaming import versions

    for folder in ("project", "log"):
        (tmp_path / folder).mkdir()
    engine = Engine(spark, tmp_path / "project", index=str(tmp_path / "index"))
    keys = ("path", "mtime", "size", "text", "deleted")
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for i, rows in enumerate([[("a.txt", 1.0, 3, "one", False), ("b.txt", 1.0, 3, "two", False)], [("a.txt", 2.0, 0, None, True), ("b.txt", 0.5, 3, "late", False)]]):
            (tmp_path / "log" / f"{i}.json").write_text("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows))
            versions.follow(spark.readStream.schema(SCHEMA).json(str(tmp_path / "log")), engine, str(tmp_path / "checkpoint"), grace=0.0).awaitTermination(60)
    finally:
        spark.conf.unset(PROVIDER)
    assert {r.text for r in engine.chunks().collect()} == {"two"}
