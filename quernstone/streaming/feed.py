"""The change feed as a stream: deduplicated, merged into a stored table, restartable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..operators import sync

FEED_SCHEMA = "external_id long, version int, updated_at timestamp_ntz, event_type string, value double"


def deduplicated(feed: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """One row for each version of a record among those that arrive within the lateness."""
    timed = feed.withColumn("_event_time", F.col("updated_at").cast("timestamp")).withWatermark("_event_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["external_id", "version"]).drop("_event_time")


class VersionStore:
    """A table of generations: each batch writes the merged store whole under a new name.

    A batch that is run again after a failure reads the generation before its
    own and writes the same one again, so repeats change nothing.  The last two
    generations stay.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _generation(self, batch: int) -> str:
        return f"{self.path}/generation-{batch + 1:09d}"

    def seed(self, store: DataFrame) -> None:
        store.write.mode("overwrite").parquet(self._generation(-1))

    def before(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(self._generation(batch - 1))

    def merge(self, changes: DataFrame, batch: int) -> None:
        sync.merge_pulled(self.before(batch), changes).write.mode("overwrite").parquet(self._generation(batch))
        if batch > 0:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self._generation(batch - 2))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def current(self) -> DataFrame:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        names = sorted(x.getPath().getName() for x in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder))
        return self.spark.read.parquet(f"{self.path}/{names[-1]}")


def pull(feed: DataFrame, store: VersionStore, checkpoint: str) -> StreamingQuery:
    """Merge all that has arrived into the store, however late: the merge itself drops repeats and older versions.

    The cursor moves on only after a batch is written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.merge(batch, number)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pull_pages(feed: DataFrame, store: VersionStore, after: tuple | None = None, page: int = 50, first_batch: int = 0) -> tuple[tuple | None, int]:
    """The same without a stream: page after page from a cursor on; returns the cursor and the number of pages.

    A page is merged before the cursor moves, so a run that ends early starts
    again from its last cursor.  The last page is the first that is not full.
    """
    n = 0
    while True:
        rows = sync.next_page(feed, after, page).collect()  # at most one page
        if rows:
            store.merge(feed.sparkSession.createDataFrame(rows, feed.schema), first_batch + n)
            n, after = n + 1, (rows[-1]["updated_at"], rows[-1]["external_id"], rows[-1]["version"])
        if len(rows) < page:
            return after, n


def _sent(r, write: Callable, attempts: int) -> tuple[str, str, int | None]:
    """Send one edit with retries under its key."""
    payload = {"event_type": r["event_type"], "value": r["value"]}
    for _ in range(attempts):
        try:
            state, version = write(str(r["external_id"]), payload, r["remote_version"], r["key"])
        except TimeoutError:
            continue
        return str(r["external_id"]), state, version
    return str(r["external_id"]), "timeout", None


def _dirty(store: DataFrame) -> DataFrame:
    return store.where("dirty").withColumn("key", sync.idempotency_key(F.col("external_id"), F.col("mutation_id")))


def push(store: DataFrame, write: Callable[[str, dict, int | None, str], tuple[str, int]], attempts: int = 3) -> list[tuple[str, str, int | None]]:
    """Send the dirty records of a small store from the driver, with retries under one key.

    ``write(id, payload, base_version, key)`` returns ("ok" or "conflict",
    version) and may raise TimeoutError after it has written; the same key makes
    it answer as the first time.  Returns (id, outcome, version).
    """
    return [_sent(r, write, attempts) for r in _dirty(store).toLocalIterator()]


def push_from_executors(store: DataFrame, connect: Callable[[], Callable], attempts: int = 3) -> DataFrame:
    """(external_id, outcome, version): the same from every partition; ``connect()`` gives a partition's writer.

    A task that runs again sends the same keys, which the remote side answers as before.
    """

    def run(reader):
        import pyarrow as pa

        write = connect()
        for batch in reader:
            out = [_sent(r, write, attempts) for r in batch.to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.string(), pa.string(), pa.int32()))], ["external_id", "outcome", "version"])

    return _dirty(store).select("external_id", "event_type", "value", "remote_version", "key").mapInArrow(run, "external_id string, outcome string, version int")


class ChangeFeedSource(DataSource):
    """A change feed behind a page function, as a streaming source.

    The offset is the pair (time, id, version) of the last row read, so any
    number of changes at one time can be paged.  Options: ``path`` of a Parquet
    feed, ``page`` rows at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return FEED_SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _FeedReader(self.options)


class _FeedReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.page = options["path"], int(options.get("page", "50"))

    #: The feed's order, and its columns.
    ORDER = ("updated_at", "external_id", "version")
    COLUMNS = ("external_id", "version", "updated_at", "event_type", "value")

    def _after(self, start: dict):
        """The rows behind an offset, as an Arrow table: times before it are not read."""
        import datetime as dt

        import pyarrow as pa
        import pyarrow.dataset as ds

        feed = ds.dataset(self.path, format="parquet")
        at, id_, version = start["after"]
        if not at:
            return feed.to_table(columns=list(self.COLUMNS))
        time = pa.scalar(dt.datetime.fromisoformat(at), feed.schema.field("updated_at").type)
        later = (ds.field("external_id") > id_) | ((ds.field("external_id") == id_) & (ds.field("version") > version))
        return feed.to_table(columns=list(self.COLUMNS), filter=(ds.field("updated_at") > time) | ((ds.field("updated_at") == time) & later))

    @staticmethod
    def _key(r) -> list:
        return [r["updated_at"].isoformat(), r["external_id"], r["version"]]

    def initialOffset(self) -> dict:
        return {"after": ["", -1, -1]}

    def _first(self, table, n: int) -> list[dict]:
        """The first rows of a table in the feed's order; no more of them become Python objects."""
        import pyarrow.compute as pc

        found = pc.select_k_unstable(table, n, sort_keys=[(x, "ascending") for x in self.ORDER]) if len(table) else []
        return table.take(found).to_pylist() if len(table) else []

    def read(self, start: dict):
        rows = self._first(self._after(start), self.page)
        end = {"after": self._key(rows[-1])} if rows else start
        return iter([tuple(r[x] for x in self.COLUMNS) for r in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = self._first(self._after(start), self.page)
        return iter([tuple(r[x] for x in self.COLUMNS) for r in rows if self._key(r) <= list(end["after"])])

    def commit(self, end: dict) -> None:
        """Nothing to forget: the feed keeps its rows."""


__all__ = ["ChangeFeedSource", "VersionStore", "deduplicated", "pull", "pull_pages", "push", "push_from_executors"]
