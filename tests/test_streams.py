"""The store of latest rows and the circuit breaker: replays, restarts, compaction, and the same answer as of a table."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from polyagree.operators.cells import keep_latest
from polyagree.streaming import breaker, logs
from polyagree.streaming.store import LatestStore, remaining, upsert_latest

DAY = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, v int"


def latest(rows):
    out = {}
    for k, day, v in rows:
        if k not in out or day >= out[k][0]:
            out[k] = (day, v)
    return {k: v for k, (_, v) in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(k, DAY + timedelta(days=day), v) for k, day, v in rows], SCHEMA)


def files_under(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_stream_keeps_the_latest_and_goes_on_after_a_stop(spark, tmp_path):
    target, checkpoint = str(tmp_path / "target"), str(tmp_path / "checkpoint")
    rnd, said = random.Random(3), []
    for number in range(5):
        batch = [(f"k{rnd.randint(0, 30)}", number * 10 + i % 7, number * 100 + i) for i in range(20)]
        batch = [r for i, r in enumerate(batch) if (r[0], r[1]) not in {x[:2] for x in batch[:i]}]  # no ties
        said += batch
        frame(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        query = upsert_latest(logs.read_log(spark, str(tmp_path / "log"), SCHEMA), ["k"], "at", target, checkpoint, compact_every=2, buckets=4)
        assert query.awaitTermination(120)
        assert {r.k: r.v for r in LatestStore(spark, target, ["k"], "at", 4).read().collect()} == latest(said)


def test_a_batch_costs_what_it_holds_and_counts_once(spark, tmp_path):
    store = LatestStore(spark, str(tmp_path / "s"), ["k"], "at", 8)
    assert store.read() is None and store.compact() is None
    rows = [(f"k{i}", 1, i) for i in range(200)] + [(None, 1, -1)]
    store.append(frame(spark, rows), 0)
    before = files_under(tmp_path / "s")
    few = [("k3", 2, 1003), ("k4", 0, 1004)]
    store.append(frame(spark, few), 1)
    assert {f: t for f, t in files_under(tmp_path / "s").items() if f in before} == before  # nothing is written again
    once = sorted(map(str, store.read().collect()))
    store.append(frame(spark, few), 1)  # replayed
    assert sorted(map(str, store.read().collect())) == once and store.read().count() == 201
    assert store.compact() == 8 and sorted(map(str, store.read().collect())) == once
    store.append(frame(spark, [("k3", 3, 5)]), 2)
    store.append(frame(spark, []), 3)
    base = files_under(tmp_path / "s/base")
    assert store.compact() == 1  # only the bucket of k3
    assert {f: t for f, t in files_under(tmp_path / "s/base").items() if f in base} == base
    assert store.vacuum() > 0 and not files_under(tmp_path / "s/delta")
    got = {r.k: r.v for r in store.read().collect()}
    assert got == latest(rows + few + [("k3", 3, 5)])
    store.append(frame(spark, [("new", 4, 7)]).withColumn("more", F.lit("x")), 4)
    assert {(r.k, r.more) for r in store.read().where("k in ('new', 'k3')").collect()} == {("new", "x"), ("k3", None)}
    wanted = spark.createDataFrame([("k1",), ("zz",), (None,)], "k string")
    assert [r.k for r in remaining(wanted, store).collect()] == ["zz"]
    assert remaining(wanted, LatestStore(spark, str(tmp_path / "none"), ["k"], "at")).count() == 3


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    store = LatestStore(spark, str(tmp_path / "s"), ["k"], "at", 4)
    store.append(frame(spark, [("a", 1, 1)]), 0)
    store._bucketed(frame(spark, [("a", 2, 2)])).write.partitionBy("__bucket").parquet(str(tmp_path / "s/delta/batch=1"))  # stopped here
    assert [r.v for r in store.read().collect()] == [1]
    store.append(frame(spark, [("a", 2, 3)]), 1)
    assert [r.v for r in store.read().collect()] == [3]


def test_store_equals_keep_latest(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 97).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 7919 % 5000).alias("at"), F.col("id").cast("int").alias("v"))
    store = LatestStore(spark, str(tmp_path / "s"), ["k"], "at", 4)
    for i in range(4):
        store.append(rows.where(F.col("v") % 4 == i), i)
        if i == 1:
            store.compact()
    want = keep_latest(rows, ["k"], F.col("at"), F.xxhash64(*sorted(rows.columns)))
    assert sorted(map(str, store.read().select("k", "at", "v").collect())) == sorted(map(str, want.collect()))


EVENT = "service string, at timestamp, id long, failed boolean"
HOUR = 3600


def plain(events, most, cool, until=None):
    """The breaker one event at a time."""
    out, by = [], {}
    for s, at, _, failed in sorted((e for e in events if e[1] is not None), key=lambda e: (str(e[0]), e[1], e[2])):
        by.setdefault(s, []).append((at, failed))
    for s, seq in by.items():
        n, last = 0, None
        for at, failed in seq:
            if n and (not failed or (at - last).total_seconds() > cool):
                if n >= most:
                    out.append((s, "closed", last, n))
                n = 0
            if failed:
                n, last = n + 1, at
                if n == most:
                    out.append((s, "opened", at, n))
        if n >= most and until is not None and last + timedelta(seconds=cool) < until:
            out.append((s, "closed", last, n))
    return sorted(out, key=str)


def made_events(n):
    rnd, out, at = random.Random(5), [], DAY
    for i in range(n):
        at += timedelta(minutes=rnd.choice([1, 5, 20, 40]))
        out.append((rnd.choice(["a", "b", "c"]), at, i, rnd.random() < 0.75))
    return out


def test_breaker_of_a_table(spark):
    events = made_events(300) + [(None, DAY, 1, True), (None, DAY, 2, True), (None, DAY, 3, True), ("n", DAY, 1, None), ("n", None, 2, True)]
    rows = spark.createDataFrame(events, EVENT)
    until = DAY + timedelta(days=30)
    got = breaker.breaker_log(rows, "service", "at", F.col("id"), F.col("failed"), 3, HOUR * 1000, F.lit(until))
    want = plain([(s, at, i, bool(f)) for s, at, i, f in events], 3, HOUR, until)
    assert sorted(((r.service, r.kind, r["at"], r.length) for r in got.collect()), key=str) == sorted(want, key=str) and len(want) > 20
    open_ = breaker.breaker_log(rows, "service", "at", F.col("id"), F.col("failed"), 3, HOUR * 1000)
    assert open_.count() < len(want)


def test_breaker_keeps_its_state_over_restarts(spark, tmp_path):
    """The stream is stopped and started after each batch; runs go on over batches, and timers close what has been quiet."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = made_events(120)
        end = events[-1][1]
        parts = [events[:37], events[37:41], events[41:100], events[100:], [("clock", end + timedelta(days=2), 0, False)], [("clock", end + timedelta(days=3), 1, False)]]
        for part in parts:
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            found = breaker.breaker(logs.read_log(spark, str(tmp_path / "log"), EVENT), "service", "at", F.col("id"), F.col("failed"), "1 second", 3, HOUR * 1000)
            query = found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            assert query.awaitTermination(180)
        got = sorted(((r.service, r.kind, r["at"], r.length) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
        until = end + timedelta(days=2)
        assert got == plain(events, 3, HOUR, until)
        log = breaker.breaker_log(spark.createDataFrame(events, EVENT), "service", "at", F.col("id"), F.col("failed"), 3, HOUR * 1000, F.lit(until))
        assert got == sorted(((r.service, r.kind, r["at"], r.length) for r in log.collect()), key=str)
    finally:
        spark.conf.unset(key)


def test_empty_streams_of_events(spark):
    assert breaker.breaker_log(spark.createDataFrame([], EVENT), "service", "at", F.col("id"), F.col("failed")).count() == 0


pytestmark = pytest.mark.filterwarnings("ignore")
