"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, ``-ln(u) / quality``, from its id; a
source's documents in ascending order of key are a weighted sample without
replacement at every length.  A source whose budget exceeds its size first
gives all documents in complete epochs; the rest of the budget is filled in the
order of keys, by prefix sums of sizes.

No source is sorted in one task: its key range is cut into buckets of a few
thousand documents, the buckets' sums give each bucket's offset, and documents
are ordered within their bucket only.  All of it is column expressions, and the
texts are read once and never move.

Defined results: a null text has size 0 and is never drawn; a null source is a
source, the last in order; ties in key go by id, then size; repeated rows are
drawn each for itself, and rows that differ only in other columns share their
draws evenly; an empty table or one without words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, need, text_or_empty, written
from .secrets import row_key

WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST_EPOCHS = 3
BUCKET_ROWS = 2000
SEED = "mix-1"


def quality(text: Column, size: Column) -> Column:
    """A weight above 0 from the mean length of words: highest where it is usual for prose."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.5)))


def uniform(id_: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, n, weight, target) from (source, source_size, n, mean): one small row per source.

    Shares go by weight; a target stops at ``most`` times its source's size and
    what is over is shared by weight among the others.  Sources in order of
    size over weight fill up first, so one pass of running sums finds the level
    at which the rest share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.get(F.array(*(F.lit(float(x)) for x in weights)), turn.cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    filled = ranked.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    tried = filled.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
    return tried.withColumn("share", F.min(fits).over(everything)["level"]).select(
        "source", "source_size", "n", "mean", "rank", "weight", F.least("limit", F.coalesce(F.col("share") * F.col("weight"), F.col("limit"))).alias("target")
    )


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality_col: str | None = None,
    seed: str = SEED,
    bucket_rows: int = BUCKET_ROWS,
    whole: bool = False,
    with_key: bool = False,
) -> DataFrame:
    """One row per row of ``df``: id, size, source_size, target, taken.

    ``taken`` counts words, repeats included.  The document at which a budget
    ends gives the words that are left of it; with ``whole`` it is taken whole
    or not, whichever is nearer.
    """
    need(df, id_col, text_col, source_col, *[quality_col] if quality_col else [])
    text = text_or_empty(text_col)
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    weight = F.greatest(F.coalesce(F.col(quality_col).cast("double"), F.lit(0.0)), F.lit(1e-9)) if quality_col else quality(F.col("__text"), F.col("size"))
    own = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("__text"), *[quality_col] if quality_col else [], size.alias("size"))
    own = own.select("id", "source", "size", weight.alias("q"), *[row_key(F.col("id"), F.col("source"), text=F.col("__text")).alias("key")] * with_key)
    own = written(own, "mix-sizes")
    rows = own.withColumn("e", -F.log(uniform(F.col("id"), seed)) / F.col("q"))

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean"))
    goal = written(targets(sizes, weights, most), "mix-targets")
    budget = F.least(F.round("target").cast("long"), (F.col("source_size") * F.lit(most)).cast("long"))
    goal = goal.withColumn("budget", budget).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long")))
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))

    joined = rows.join(goal.select(F.col("source").alias("goal_source"), "rank", "source_size", "target", "n", "mean", "epochs", "rest"), F.col("source").eqNullSafe(F.col("goal_source")))
    buckets = F.ceil(F.col("n") / F.lit(float(bucket_rows)))
    placed = joined.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("e") * F.col("mean"))) * buckets).cast("long"))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).select("rank", "bucket", "offset")
    inside = Window.partitionBy("rank", "bucket").orderBy("e", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    done = placed.join(offsets, ["rank", "bucket"]).withColumn("before", before)
    left = F.col("rest") - F.col("before")
    part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least("size", left))
    taken = F.col("epochs") * F.col("size") + part
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *["key"] * with_key)


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, whole: each as often as it is taken, with the columns of ``df``."""
    key, times, copy, n, place = (fresh(df, x) for x in ("mix_key", "mix_times", "mix_copy", "mix_rows", "mix_place"))
    taken = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, whole=True, with_key=True, **options)
    drawn = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)
    count = taken.groupBy(F.col("key").alias(key)).agg(F.sum(drawn).cast("int").alias(times), F.count(F.lit(1)).cast("int").alias(n)).where(F.col(times) > 0)
    keyed = df.withColumn(key, row_key(F.col(id_col), F.col(source_col).cast("string"), text=text_or_empty(text_col)))
    # rows of one key may differ in other columns: each gets its share of the draws, the first ones one more where they do not divide
    order = [F.xxhash64(F.to_json(F.struct(*(F.col(x) for x in df.columns if x != text_col))))]
    placed = keyed.join(count, key).withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    share = F.expr(f"{times} div {n}").cast("int") + (F.col(place) <= F.col(times) % F.col(n)).cast("int")
    return placed.withColumn(times, share).where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*df.columns)


#: What op5 returns, for DuckDB.
ORACLE_SQL = r"""
WITH own AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(coalesce(text, '')) AS chars
    FROM documents
), rows_ AS (
    SELECT doc_id, source, size,
        -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
            / (1.0::DOUBLE / (1.0::DOUBLE + abs(chars::DOUBLE / greatest(size, 1)::DOUBLE - 6.5::DOUBLE))) AS e
    FROM own
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        source_size * 3.0::DOUBLE AS most
    FROM sizes
), levels AS (
    SELECT *, most / weight AS ratio,
        (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM ranked
), goal AS (
    SELECT *, least(most, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight, most)) AS target FROM levels
), budgets AS (
    SELECT *, least(CAST(round(target) AS BIGINT), source_size * 3) AS budget FROM goal
), drawn AS (
    SELECT r.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.budget // g.source_size ELSE 0 END AS epochs, g.budget,
        coalesce(sum(r.size) OVER (PARTITION BY g.rank ORDER BY r.e, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM rows_ r JOIN budgets g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
    CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM drawn
"""
