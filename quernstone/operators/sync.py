"""Two-way synchronisation of a local store with a remote change feed, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(feed: DataFrame, since: str, limit: int = 50, overlap: str = "1 MINUTE") -> DataFrame:
    """The next changes after a cursor, a little overlapped, in order of time and id."""
    begin = F.lit(since).cast("timestamp_ntz") - F.expr(f"INTERVAL {overlap}")
    return feed.where(F.col("updated_at") > begin).orderBy("updated_at", "external_id", "version").limit(limit)


def latest(feed: DataFrame) -> DataFrame:
    """Each record's newest version; repeats of a version count once."""
    columns = [x for x in feed.columns if x != "external_id"]
    return feed.groupBy("external_id").agg(F.max_by(F.struct(*columns), "version").alias("x")).select("external_id", "x.*")


def merge_pulled(store: DataFrame, feed: DataFrame) -> DataFrame:
    """The store after a pull: a local edit stays if it is later than the remote change, else the remote version wins.

    A version that the store has already, clean, changes nothing.  The number
    of local edits is kept, so a later edit never repeats an earlier key.
    """
    new = latest(feed).select("external_id", *(F.col(x).alias(f"r_{x}") for x in ("version", "updated_at", "event_type", "value")))
    both = store.join(new, "external_id", "full")
    known = F.col("remote_version").isNotNull() | F.col("updated_at_utc").isNotNull()
    applied = known & ~F.col("dirty") & (F.col("remote_version") == F.col("r_version"))
    local_wins = known & F.col("dirty") & (F.col("updated_at_utc") > F.col("r_updated_at"))
    keep = F.col("r_version").isNull() | F.coalesce(applied, F.lit(False)) | F.coalesce(local_wins, F.lit(False))
    return both.select(
        "external_id",
        F.when(keep, F.col("event_type")).otherwise(F.col("r_event_type")).alias("event_type"),
        F.when(keep, F.col("value")).otherwise(F.col("r_value")).alias("value"),
        F.when(keep, F.col("remote_version")).otherwise(F.col("r_version")).alias("remote_version"),
        F.when(keep, F.col("updated_at_utc")).otherwise(F.col("r_updated_at")).alias("updated_at_utc"),
        F.when(keep, F.col("dirty")).otherwise(F.lit(False)).alias("dirty"),
        F.coalesce("mutation_id", F.lit(0)).alias("mutation_id"),
    )


def push_outcomes(store: DataFrame, remote: DataFrame) -> DataFrame:
    """What becomes of each local edit: created, updated, reconciled with an equal remote row, or a conflict."""
    there = remote.select("external_id", F.col("version").alias("r_version"), F.col("event_type").alias("r_event_type"), F.col("value").alias("r_value"))
    rows = store.where("dirty").join(there, "external_id", "left")
    equal = F.col("event_type").eqNullSafe(F.col("r_event_type")) & F.col("value").eqNullSafe(F.col("r_value"))
    create, exists = F.col("remote_version").isNull(), F.col("r_version").isNotNull()
    outcome = (
        F.when(create & ~exists, "create")
        .when(create & equal, "reconcile_create")
        .when(create, "create_conflict")
        .when(exists & (F.col("remote_version") == F.col("r_version")), "update")
        .when(exists & equal, "reconcile_update")
        .otherwise("update_conflict")
    )
    return rows.select("external_id", outcome.alias("outcome"), F.when(outcome.isin("create", "update"), F.coalesce("r_version", F.lit(0)) + 1).otherwise(F.col("r_version")).cast("int").alias("version"))


def both_ways(store: DataFrame, feed: DataFrame) -> DataFrame:
    """A pull and then a push against the remote side that the feed describes: the store after both."""
    pulled = merge_pulled(store, feed)
    return acknowledged(pulled, push_outcomes(pulled, latest(feed)))


def next_page(feed: DataFrame, after: tuple | None, limit: int = 50) -> DataFrame:
    """The next changes behind a cursor (time, id, version), so any number of changes at one time can be paged."""
    if after is not None:
        at, id_, version = (F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1]), F.lit(after[2]))
        later = (F.col("external_id") > id_) | ((F.col("external_id") == id_) & (F.col("version") > version))
        # the first condition alone reaches the scan
        feed = feed.where(F.col("updated_at") >= at).where((F.col("updated_at") > at) | later)
    return feed.orderBy("updated_at", "external_id", "version").limit(limit)


def acknowledged(store: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The store after a push: written and reconciled records are clean at their version; conflicts stay as they are."""
    done = outcomes.where(~F.col("outcome").endswith("conflict")).select("external_id", F.col("version").alias("a_version"))
    rows = store.join(done, "external_id", "left")
    return rows.withColumns({"remote_version": F.coalesce("a_version", "remote_version"), "dirty": F.col("dirty") & F.col("a_version").isNull()}).drop("a_version")


def apply_writes(remote: DataFrame, answered: DataFrame, requests: DataFrame) -> DataFrame:
    """What a versioned remote side answers to writes (external_id, base_version, key), one for each record.

    A key that it has answered before gets the same version again; a base other
    than the current version is a conflict; any other write makes a new version,
    the first for a new record.
    """
    now = remote.select("external_id", F.col("version").alias("now"))
    before = answered.select("key", F.col("version").alias("before"))
    rows = requests.join(before, "key", "left").join(now, "external_id", "left")
    same = F.coalesce("base_version", F.lit(0)) == F.coalesce("now", F.lit(0))
    status = F.when(F.col("before").isNotNull(), "replay").when(same, "ok").otherwise("conflict")
    version = F.when(F.col("before").isNotNull(), F.col("before")).when(same, F.coalesce("now", F.lit(0)) + 1).otherwise(F.col("now"))
    return rows.select("external_id", status.alias("status"), version.cast("int").alias("version"))


def get(records: DataFrame, external_id: int) -> DataFrame:
    """A record by its id."""
    return records.where(F.col("external_id") == external_id)


def idempotency_key(external_id: Column, mutation_id: Column) -> Column:
    """The first half of a digest of id and number of edit: equal for retries, different for every edit."""
    document = F.concat(F.lit('{"id": "'), external_id.cast("string"), F.lit('", "mutation_id": '), mutation_id.cast("string"), F.lit("}"))
    return F.substring(F.sha2(document, 256), 1, 32)


def to_utc(c: Column, zone: str = "+08:00") -> Column:
    """A remote local time as UTC."""
    return F.to_utc_timestamp(c, zone)


def mark_dirty(store: DataFrame, edits: DataFrame) -> DataFrame:
    """Local edits: new contents, one more edit, time of the edit."""
    new = edits.select("external_id", F.col("event_type").alias("e_type"), F.col("value").alias("e_value"), F.col("edited_at").alias("e_at"))
    rows = store.join(new, "external_id", "left")
    touched = F.col("e_at").isNotNull()
    return rows.withColumns(
        {
            "event_type": F.coalesce("e_type", "event_type"),
            "value": F.coalesce("e_value", "value"),
            "updated_at_utc": F.coalesce("e_at", "updated_at_utc"),
            "dirty": F.col("dirty") | touched,
            "mutation_id": F.col("mutation_id") + F.when(touched, 1).otherwise(0),
        }
    ).drop("e_type", "e_value", "e_at")


def invariants(store: DataFrame, remote: DataFrame, write_log: DataFrame) -> DataFrame:
    """Counts that should be 0 once both sides agree: missing, stale, drifted clean records, and repeated writes of a version."""
    both = store.join(latest(remote).select("external_id", F.col("version").alias("r_version"), F.col("value").alias("r_value")), "external_id", "full")
    clean = ~F.col("dirty")
    counted = both.agg(
        F.count_if(F.col("dirty").isNull()).alias("missing"),
        F.count_if(clean & (F.col("remote_version") < F.col("r_version"))).alias("stale"),
        F.count_if(clean & (F.col("remote_version") == F.col("r_version")) & ~F.col("value").eqNullSafe(F.col("r_value"))).alias("drifted"),
    )
    twice = write_log.groupBy("external_id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("written_twice"))
    return counted.join(twice)  # one row each
