"""Synchronisation: merge rules, pushing with faults, the feed as a stream."""

from __future__ import annotations

import datetime as dt

from conftest import rows_of
from pyspark.sql import functions as F

from quernstone.operators import sync
from quernstone.sources import models
from quernstone.streaming import feed as stream

STORE = "external_id long, event_type string, value double, remote_version int, updated_at_utc timestamp_ntz, dirty boolean, mutation_id int"


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 0, minute)


def store_of(spark, *rows):
    return spark.createDataFrame(list(rows), STORE)


def feed_of(spark, *rows):
    return spark.createDataFrame(list(rows), stream.FEED_SCHEMA)


def test_later_local_edit_stays(spark):
    store = store_of(spark, (1, "a", 9.0, 1, at(10), True, 1), (2, "a", 9.0, 1, at(3), True, 4), (3, "a", 1.0, 2, at(5), False, 0))
    feed = feed_of(spark, (1, 2, at(5), "b", 2.0), (2, 2, at(5), "b", 2.0), (3, 2, at(5), "b", 2.0), (4, 1, at(1), "n", 4.0))
    got = {r.external_id: r for r in sync.merge_pulled(store, feed).collect()}
    assert (got[1].value, got[1].dirty, got[1].remote_version) == (9.0, True, 1)
    assert (got[2].value, got[2].dirty, got[2].remote_version, got[2].mutation_id) == (2.0, False, 2, 4)
    assert got[3].value == 1.0  # this version is applied already
    assert (got[4].value, got[4].remote_version) == (4.0, 1)


def test_equal_times_go_to_the_remote_side(spark):
    store = store_of(spark, (1, "a", 9.0, 1, at(5), True, 1))
    assert sync.merge_pulled(store, feed_of(spark, (1, 2, at(5), "b", 2.0))).first().value == 2.0


def test_page_overlaps_and_orders_ties(spark):
    feed = feed_of(spark, *((k, 1, at(5), "a", 1.0) for k in (3, 1, 2)), (9, 1, at(3), "a", 1.0))
    assert [r.external_id for r in sync.page(feed, "2024-01-01 00:05:00", 2).collect()] == [1, 2]


def test_push_outcomes_and_acknowledgement(spark):
    store = store_of(
        spark, (1, "a", 1.0, None, at(1), True, 1), (2, "a", 1.0, None, at(1), True, 1), (3, "a", 1.0, None, at(1), True, 1), (4, "a", 1.0, 1, at(1), True, 1), (5, "a", 1.0, 1, at(1), True, 1), (6, "a", 1.0, 1, at(1), True, 1), (7, "a", 1.0, 1, at(1), False, 0)
    )
    remote = feed_of(spark, (2, 3, at(1), "a", 1.0), (3, 3, at(1), "b", 1.0), (4, 1, at(1), "z", 0.0), (5, 2, at(1), "a", 1.0), (6, 2, at(1), "z", 0.0))
    outcomes = sync.push_outcomes(store, remote)
    assert {r.external_id: (r.outcome, r.version) for r in outcomes.collect()} == {
        1: ("create", 1), 2: ("reconcile_create", 3), 3: ("create_conflict", 3), 4: ("update", 2), 5: ("reconcile_update", 2), 6: ("update_conflict", 2),
    }
    after = {r.external_id: (r.dirty, r.remote_version) for r in sync.acknowledged(store, outcomes).collect()}
    assert after == {1: (False, 1), 2: (False, 3), 3: (True, None), 4: (False, 2), 5: (False, 2), 6: (True, 1), 7: (False, 1)}


def test_keys_differ_for_every_edit(spark):
    store = store_of(spark, (1, "a", 1.0, 1, at(1), False, 0))
    edit = spark.createDataFrame([(1, "a", 1.0, at(9))], "external_id long, event_type string, value double, edited_at timestamp_ntz")
    once = sync.mark_dirty(store, edit)
    twice = sync.mark_dirty(once, edit)
    keys = [x.select(sync.idempotency_key(F.col("external_id"), F.col("mutation_id")).alias("k")).first().k for x in (once, once, twice)]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 32


def test_push_retries_under_one_key(spark):
    store = store_of(spark, (1, "a", 1.0, 1, at(1), True, 1), (2, "a", 1.0, 1, at(1), True, 1))
    written: dict[str, int] = {}
    calls = []

    def write(id_, payload, base, key):
        calls.append((id_, key))
        first = key not in written
        written.setdefault(key, base + 1)
        if id_ == "1" and first:
            raise TimeoutError  # after the write
        return "ok", written[key]

    assert sorted(stream.push(store, write)) == [("1", "ok", 2), ("2", "ok", 2)]
    assert len(calls) == 3 and len(written) == 2


def test_times_become_utc(spark):
    rows = spark.createDataFrame([("2026-01-01 08:00:00",)], "t string").select(sync.to_utc(F.col("t").cast("timestamp")).cast("string").alias("u"))
    assert rows.first().u == "2026-01-01 00:00:00"


def test_stream_equals_batch(spark, sf_dir):
    from quernstone.plans.queries import QUERIES

    assert rows_of(QUERIES["sync_stream_pull"](spark, sf_dir)) == rows_of(sync.latest(models.change_feed(spark, sf_dir)))


def test_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = stream.VersionStore(spark, f"file://{tmp_path}/store")
    store.seed(store_of(spark).limit(0))
    changes = feed_of(spark, (1, 1, at(1), "a", 1.0), (1, 2, at(2), "b", 2.0))
    store.merge(changes, 0)
    before = rows_of(store.current())
    store.merge(changes, 0)
    assert rows_of(store.current()) == before and len(before) == 1


def test_source_pages_ties(spark, tmp_path):
    feed_of(spark, *((k, 1, at(5), "a", 1.0) for k in range(7))).coalesce(1).write.parquet(f"{tmp_path}/feed")
    reader = stream._FeedReader({"path": f"{tmp_path}/feed", "page": "3"})
    offset, seen = reader.initialOffset(), []
    for _ in range(4):
        rows, offset = reader.read(offset)
        seen += [r[0] for r in rows]
    assert seen == list(range(7))


def test_pages_equal_one_merge(spark, tmp_path):
    feed = feed_of(spark, *((k % 5, 1 + k // 5, at(5 + k // 7), "a", float(k)) for k in range(23)))
    store = stream.VersionStore(spark, f"file://{tmp_path}/store")
    store.seed(store_of(spark).limit(0))
    cursor, n = stream.pull_pages(feed, store, page=4)
    assert n == 6 and cursor[0] == at(8)
    assert rows_of(store.current()) == rows_of(sync.merge_pulled(store_of(spark).limit(0), feed))
    assert stream.pull_pages(feed, store, cursor, page=4, first_batch=n) == (cursor, 0)
    import os

    assert len(os.listdir(f"{tmp_path}/store")) <= 3


def test_late_versions_are_not_lost(spark, tmp_path):
    store = stream.VersionStore(spark, f"file://{tmp_path}/store")
    store.seed(store_of(spark).limit(0))
    for k, rows in enumerate([[(1, 1, at(50), "a", 1.0)], [(2, 1, at(1), "late", 2.0)]]):
        feed_of(spark, *rows).write.parquet(f"{tmp_path}/feed/{k}")
        source = spark.readStream.schema(stream.FEED_SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/feed")
        stream.pull(source, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert {r.external_id for r in store.current().collect()} == {1, 2}


def test_push_from_executors(spark):
    store = store_of(spark, (1, "a", 1.0, 1, at(1), True, 1), (2, "a", 1.0, None, at(1), True, 1), (3, "a", 1.0, 4, at(1), False, 0))

    def connect():
        tries: dict[str, int] = {}

        def write(id_, payload, base, key):
            tries[key] = tries.get(key, 0) + 1
            if tries[key] == 1:
                raise TimeoutError
            return "ok", (base or 0) + 1

        return write

    assert sorted(tuple(r) for r in stream.push_from_executors(store, connect).collect()) == [("1", "ok", 2), ("2", "ok", 1)]


def test_pull_then_push(spark):
    store = store_of(spark, (1, "a", 9.0, 1, at(10), True, 1), (2, "a", 9.0, 1, at(3), True, 4), (3, "n", 5.0, None, at(9), True, 1))
    feed = feed_of(spark, (1, 1, at(5), "b", 2.0), (2, 2, at(5), "b", 2.0))
    got = {r.external_id: (r.value, r.remote_version, r.dirty) for r in sync.both_ways(store, feed).collect()}
    assert got == {1: (9.0, 2, False), 2: (2.0, 2, False), 3: (5.0, 1, False)}
