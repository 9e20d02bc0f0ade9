"""The tenant health report over a match-event ledger.

Each metric family is aggregated to its own grain before anything is joined, so
no join multiplies rows, and every aggregate combines on the map side.  The
95th percentile rides in the same aggregation as the other latency metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Ledger = dict[str, DataFrame]


def _within(first: str, last: str, back: int = 0) -> Column:
    """A range on the stored time itself, which reaches the scan."""
    begin = F.date_sub(F.lit(first).cast("date"), back) if back else F.lit(first).cast("date")
    return (F.col("created_at") >= begin.cast("timestamp_ntz")) & (F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))


def _daily(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("created_at"))


def order_metrics(ledger: Ledger, first: str, last: str) -> DataFrame:
    """Lines and customers by tenant, plan, channel and day."""
    lines = _daily(ledger["order_line"].where(_within(first, last)))
    return lines.join(ledger["tenant"].select("tenant_id", "plan"), "tenant_id").groupBy("tenant_id", "plan", "channel", "day").agg(
        F.count_distinct("line_id").alias("lines_total"), F.count_distinct("customer_id").alias("distinct_customers")
    )


def channel_event_metrics(ledger: Ledger, first: str, last: str) -> DataFrame:
    """Accepted lines and candidates by tenant, channel and day of the line."""
    lines = _daily(ledger["order_line"].where(_within(first, last))).select("tenant_id", "line_id", "channel", "day")
    events = ledger["match_event"].where(_within(first, last)).select("line_id", "accepted")
    # events of a line come together first: one row for each line reaches the distinct count
    by_line = events.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.max("accepted").alias("any_accepted"))
    joined = lines.join(by_line, "line_id")
    return joined.groupBy("tenant_id", "channel", "day").agg(
        F.count_distinct(F.when(F.col("any_accepted"), F.col("line_id"))).alias("lines_accepted"), F.sum("n").alias("candidates_considered")
    )


def day_event_metrics(ledger: Ledger, first: str, last: str) -> DataFrame:
    """Score, latency and disabled items by tenant and day of the event."""
    events = _daily(ledger["match_event"].where(_within(first, last)))
    joined = events.join(ledger["item"], ["tenant_id", "item_code"], "left")
    return joined.groupBy("tenant_id", "day").agg(
        F.avg(F.when(F.col("accepted"), F.col("score"))).alias("avg_accept_score"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum(F.when(F.col("accepted") & F.col("disabled"), 1).otherwise(0)).alias("accepted_disabled"),
    )


def p95_window(ledger: Ledger, first: str, last: str) -> DataFrame:
    """Nearest-rank 95th percentile of latency by row numbers."""
    events = _daily(ledger["match_event"].where(_within(first, last)))
    group = Window.partitionBy("tenant_id", "day")
    ranked = events.select("tenant_id", "day", "latency_ms", F.row_number().over(group.orderBy("latency_ms")).alias("rn"), F.count(F.lit(1)).over(group).alias("cnt"))
    chosen = F.col("rn") == F.expr("(cnt * 95 + 99) div 100")
    return ranked.groupBy("tenant_id", "day").agg(F.max(F.when(chosen, F.col("latency_ms"))).alias("p95_latency_ms"))


def p95_aggregate(ledger: Ledger, first: str, last: str) -> DataFrame:
    """The same in one aggregation without a sort of all events."""
    events = _daily(ledger["match_event"].where(_within(first, last)))
    return events.groupBy("tenant_id", "day").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p95_latency_ms"))


def p95_cross_check(ledger: Ledger, first: str, last: str) -> DataFrame:
    """Both forms of the percentile side by side."""
    a, b = p95_window(ledger, first, last).withColumnRenamed("p95_latency_ms", "p95_window"), p95_aggregate(ledger, first, last).withColumnRenamed("p95_latency_ms", "p95_aggregate")
    return a.join(b, ["tenant_id", "day"], "full").withColumn("equal", F.col("p95_window").eqNullSafe(F.col("p95_aggregate")))


def event_items(ledger: Ledger, first: str, last: str) -> DataFrame:
    """Items met by tenant and day, from the day before the window on."""
    return _daily(ledger["match_event"].where(_within(first, last, 1))).select("tenant_id", "day", "item_code").distinct()


def repeat_items(ledger: Ledger, first: str, last: str) -> DataFrame:
    """How many of a day's items were there the day before: one window over the distinct items instead of a self join."""
    before = F.lag("day").over(Window.partitionBy("tenant_id", "item_code").orderBy("day"))
    marked = event_items(ledger, first, last).withColumn("again", before == F.date_sub("day", 1))
    return marked.where(F.col("again") & (F.col("day") >= F.lit(first).cast("date"))).groupBy("tenant_id", "day").agg(F.count(F.lit(1)).alias("repeat_items_prev_day"))


def busiest_tenant_day(ledger: Ledger, first: str, last: str) -> DataFrame:
    """The tenant-day with most events (ties: smaller tenant, earlier day) and its 95th percentile."""
    events = _daily(ledger["match_event"].where(_within(first, last)))
    counted = events.groupBy("tenant_id", "day").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p95_latency_ms"))
    return counted.orderBy(F.col("n").desc(), "tenant_id", "day").limit(1)


#: The optional metrics, for ablations.
OPTIONAL = ("repeat_items_prev_day", "lines_accepted", "accepted_disabled", "candidates_considered")


def tenant_health(ledger: Ledger, first: str, last: str, without: tuple[str, ...] = (), tenant_id: int | None = None) -> DataFrame:
    """The report: 14 columns by tenant, plan, channel and day, ordered by tenant, channel, day."""
    if tenant_id is not None:
        ledger = {k: v.where(F.col("tenant_id") == tenant_id) for k, v in ledger.items()}
    out = order_metrics(ledger, first, last)
    out = out.join(channel_event_metrics(ledger, first, last), ["tenant_id", "channel", "day"], "left")
    daily = day_event_metrics(ledger, first, last).join(p95_aggregate(ledger, first, last), ["tenant_id", "day"], "left")
    out = out.join(daily, ["tenant_id", "day"], "left")
    if "repeat_items_prev_day" not in without:
        out = out.join(repeat_items(ledger, first, last), ["tenant_id", "day"], "left")

    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    columns = [
        "tenant_id", "plan", "channel", "day", "lines_total", zero("lines_accepted"), zero("candidates_considered"), "avg_accept_score", "max_latency_ms", "avg_latency_ms",
        "distinct_customers", *[zero("repeat_items_prev_day")] * ("repeat_items_prev_day" not in without), zero("accepted_disabled"), "p95_latency_ms",
    ]
    return out.select(*columns).drop(*without).orderBy("tenant_id", "channel", "day")


#: The report as correlated subqueries over the grouped lines; Spark takes their correlation apart.
CORRELATED = """
WITH grouped AS (
    SELECT l.tenant_id, t.plan, l.channel, to_date(l.created_at) AS day, count(DISTINCT l.line_id) AS lines_total, count(DISTINCT l.customer_id) AS distinct_customers
    FROM {order_line} l JOIN {tenant} t ON t.tenant_id = l.tenant_id
    WHERE to_date(l.created_at) BETWEEN CAST(:first AS DATE) AND CAST(:last AS DATE)
    GROUP BY l.tenant_id, t.plan, l.channel, to_date(l.created_at)
)
SELECT g.tenant_id, g.plan, g.channel, g.day, g.lines_total,
    (SELECT count(DISTINCT e.line_id) FROM {match_event} e JOIN {order_line} o ON o.line_id = e.line_id
        WHERE e.accepted AND e.tenant_id = g.tenant_id AND o.channel = g.channel AND to_date(o.created_at) = g.day) AS lines_accepted,
    (SELECT count(*) FROM {match_event} e JOIN {order_line} o ON o.line_id = e.line_id
        WHERE o.tenant_id = g.tenant_id AND o.channel = g.channel AND to_date(o.created_at) = g.day) AS candidates_considered,
    (SELECT avg(e.score) FROM {match_event} e WHERE e.accepted AND e.tenant_id = g.tenant_id AND to_date(e.created_at) = g.day) AS avg_accept_score,
    (SELECT max(e.latency_ms) FROM {match_event} e WHERE e.tenant_id = g.tenant_id AND to_date(e.created_at) = g.day) AS max_latency_ms,
    (SELECT avg(e.latency_ms) FROM {match_event} e WHERE e.tenant_id = g.tenant_id AND to_date(e.created_at) = g.day) AS avg_latency_ms,
    g.distinct_customers,
    (SELECT count(DISTINCT e.item_code) FROM {match_event} e
        JOIN (SELECT DISTINCT tenant_id, item_code, date_add(to_date(created_at), 1) AS day FROM {match_event}) p
            ON p.tenant_id = e.tenant_id AND p.item_code = e.item_code AND p.day = to_date(e.created_at)
        WHERE e.tenant_id = g.tenant_id AND to_date(e.created_at) = g.day) AS repeat_items_prev_day,
    (SELECT count(*) FROM {match_event} e JOIN {item} i ON i.tenant_id = e.tenant_id AND i.item_code = e.item_code
        WHERE i.disabled AND e.accepted AND e.tenant_id = g.tenant_id AND to_date(e.created_at) = g.day) AS accepted_disabled
FROM grouped g
ORDER BY g.tenant_id, g.channel, g.day
"""


def correlated(spark: SparkSession, ledger: Ledger, first: str, last: str) -> DataFrame:
    """The report's first 13 columns in its correlated form."""
    return spark.sql(CORRELATED, args={"first": first, "last": last}, **ledger)
