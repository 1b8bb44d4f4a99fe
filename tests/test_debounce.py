"""Batches from the first event on, on a stream and as a batch."""

import datetime as dt
import random

import pytest

from factgraph.streaming import debounce as D

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def plain(rows, wait, policy="deleted"):
    """(root, start, path, kind) by walking through the events of each root."""
    out = []
    for root in {r[0] for r in rows}:
        start, batch = None, {}
        for ms, kind, path in sorted((ms, kind, path) for r, ms, kind, path in rows if r == root):
            if start is None or ms >= start + wait:
                out += [(root, start, p, k) for p, k in batch.items()]
                start, batch = ms, {}
            batch[path] = "deleted" if policy == "deleted" and batch.get(path) == "deleted" else kind
        out += [(root, start, p, k) for p, k in batch.items()]
    return sorted(out)


def some_events(seed, n):
    rng = random.Random(seed)
    at, rows = 0, []
    for _ in range(n):
        at += rng.choice([0, 1, 40, 300, 499, 500, 501, 2000])
        rows.append((rng.choice("ab"), at, rng.choice(["changed", "changed", "deleted"]), f"f{rng.randint(0, 4)}.py"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(r, START + dt.timedelta(milliseconds=ms), k, p) for r, ms, k, p in rows],
                                 "root string, ts timestamp, kind string, path string")


def found(df):
    zero = START.timestamp() * 1000
    rows = df.selectExpr("root", "unix_millis(batch_start) AS at", "path", "kind").collect()
    return sorted((r.root, int(r["at"] - zero), r.path, r.kind) for r in rows)


@pytest.mark.parametrize("policy", ["deleted", "last"])
def test_batch(spark, policy):
    rows = some_events(1, 300)
    assert found(D.debounce(frame(spark, rows).repartition(5), ["root"], 500, policy)) == plain(rows, 500, policy)
    assert D.debounce(frame(spark, rows[:1]).limit(0), ["root"]).count() == 0


def test_a_wait_has_a_fixed_end(spark):
    # events every 300 ms: a burst would never end, a wait does
    rows = [("a", 300 * i, "changed", f"f{i}.py") for i in range(6)]
    assert [(s, p) for _, s, p, _ in found(D.debounce(frame(spark, rows), ["root"], 500))] == [
        (0, "f0.py"), (0, "f1.py"), (600, "f2.py"), (600, "f3.py"), (1200, "f4.py"), (1200, "f5.py")]


def test_stream_equals_batch(spark, tmp_path):
    """Events in any order within two seconds, in several micro-batches, and one that is too late."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", D.ROCKSDB)
    try:
        rows = some_events(2, 120)
        rng = random.Random(3)
        shuffled = sorted(rows, key=lambda r: r[1] + rng.randint(0, 1900))
        feed = tmp_path / "feed"
        end = max(r[1] for r in rows)
        pieces = [shuffled[i:i + 30] for i in range(0, 120, 30)]
        pieces.append([(r, end + 60_000, "changed", "end.py") for r in "ab"])       # lets the watermark pass
        pieces.append([("a", 5, "changed", "late.py"), ("a", end + 120_000, "changed", "end.py")])
        pieces.append([("b", end + 180_000, "changed", "end.py")])
        for i, piece in enumerate(pieces):
            frame(spark, piece).coalesce(1).write.json(str(feed / f"{i}"))
        stream = spark.readStream.schema("root string, ts timestamp, kind string, path string").option(
            "maxFilesPerTrigger", 1).json(str(feed / "*"))
        out = D.debounce(stream, ["root"], 500, late="2 seconds")
        half = str(tmp_path / "check")
        for _ in range(2):      # the second start goes on from the checkpoint and adds nothing
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", half) \
                .trigger(availableNow=True).start()
            query.awaitTermination()
        got = [r for r in found(spark.read.parquet(str(tmp_path / "out"))) if r[2] != "end.py"]
        assert got == plain(rows, 500)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
